"""Column-level text helpers.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrad import dims

# Basic token pattern: a run of word characters or one other non-space
# character (fixed value; JVM ``\w`` is ASCII, as in the reference's Java).
BASIC_TOKEN = r"\w+|\S"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_label(type_col: str | Column) -> Column:
    """Label as used by the model: lower-cased type."""
    return F.lower(_c(type_col))


def first_words(text: str | Column, n: int) -> Column:
    """Keep the first ``n`` words, splitting on single spaces only (P6):
    newlines are not separators and empty words count."""
    return F.substring_index(_c(text), " ", n)


def plain_input(text: str | Column, max_length: int = dims.MAX_LENGTH) -> Column:
    """Model input without a prompt: first max_length-10 words."""
    return first_words(text, max_length - 10)


def prompt(text: str | Column, n_words: int, indent: int = 12) -> Column:
    """One-shot instruction + first ``n_words`` words + answer marker.
    Training uses n = max_length//2 = 256 and indent 12; the generation
    path uses n = 300 and indent 8."""
    return F.concat(F.lit(dims.instruction(indent)), first_words(text, n_words),
                    F.lit(f"\n{dims.ANSWER_MARK}\n"))


def training_text(prompt_col: str | Column, label_col: str | Column,
                  split_col: str | Column) -> Column:
    """Prompt + target on training rows, prompt alone otherwise."""
    return F.when(_c(split_col) == "train", F.concat(_c(prompt_col), _c(label_col))) \
        .otherwise(_c(prompt_col))


def basic_tokens(text: str | Column) -> Column:
    """Lower-cased basic tokens of a text (F3): ``\\w+`` runs or single
    non-space characters, in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(BASIC_TOKEN), 0), F.lower)


def parse_answer(g: str | Column) -> Column:
    """Answer in generated text (F14): only when both markers occur, the
    text after the last answer marker, stripped, then cut at the end
    marker - strip comes first, so a space before the end marker stays."""
    g = _c(g)
    tail = F.substring_index(g, dims.ANSWER_MARK, -1)
    stripped = F.regexp_replace(tail, r"^\s+|\s+$", "")
    ans = F.substring_index(stripped, dims.END_MARK, 1)
    has_both = F.contains(g, F.lit(dims.ANSWER_MARK)) & F.contains(g, F.lit(dims.END_MARK))
    return F.when(has_both, ans)


def with_gold(result: str | Column, gold: str | Column) -> Column:
    """Logged generation: output text followed by the gold answer."""
    return F.concat(_c(result), F.lit("\nGold Answer: "), _c(gold))
