"""Training-data operators: search, filters, deduplication, mixing, tokens.

Nothing else in the library imports this package. Every operator takes and
returns DataFrames; the registered queries are in ``queries.py``.
"""
