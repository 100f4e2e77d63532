"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    r = compare(spark, duck, SF_SMALL, key, QUERIES[key], ORACLE[key])
    assert r["status"] == "ok", r


def test_every_oracle_key_is_registered():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["post_id", "posts", "type", "order_key"]
    assert df.count() > 0
