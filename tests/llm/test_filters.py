"""Bitmaps that decide rows before texts are shuffled, and the plans beyond the broadcast limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tetrad.llm import common, exactdedup, tokencount


def texts(spark):
    """Copies, their variants in blanks, single texts, nulls and a null id."""
    rows = [(i, f"copy {i % 7}  text", i) for i in range(60)] + [(100 + i, f"single {i}", i) for i in range(300)]
    rows += [(500, None, 0), (501, "", 1), (502, " \t", 2), (None, "copy 3 text", 3), (None, "nobody's", 4), (None, "nobody's", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_a_filter_has_all_its_values_and_few_others(spark, n):
    values = spark.range(n).select(F.xxhash64("id").alias("h"))
    words = common.bit_filter(values, "h", n)
    assert len(words) * 64 >= max(16 * n, common.FILTER_BITS[0]) and len(words) * 8 <= 1 << 27
    own = np.array([r.h for r in values.collect()], np.int64)
    assert common.maybe_in(words, own).all()
    others = np.array([r.h for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).collect()])
    assert common.maybe_in(words, others).mean() < 0.08


def test_bits_of_all_parts(spark):
    bits = common.FILTER_BITS[0]
    at = [0, 63, 64, 64 * common.PART_WORDS - 1, bits - 1, -1, -bits, 5 * bits + 77]
    words = common.bit_filter(spark.createDataFrame([(x,) for x in at], "h long"), "h", 8)
    assert int(np.bitwise_count(words).sum()) == len({x % bits for x in at})
    assert common.maybe_in(words, np.array(at)).all() and not common.maybe_in(words, np.array([1, 65, bits - 2])).any()


def test_exact_dedup_beyond_the_limit(spark, monkeypatch):
    small = rows_of(exactdedup.duplicate_groups(texts(spark)))
    whole = rows_of(exactdedup.duplicate_groups(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    monkeypatch.setattr(exactdedup, "ROUTE_BROADCAST_MAX", 0)
    assert rows_of(exactdedup.duplicate_groups(texts(spark))) == small
    assert rows_of(exactdedup.duplicate_groups(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))) == whole
    assert exactdedup.duplicate_groups(texts(spark).limit(0)).count() == 0


def test_texts_that_are_single_do_not_reach_the_join(spark):
    routed = spark.createDataFrame([("copy",), ("other",)], "text string")
    to_batches = lambda df: df.select(F.col("text").cast("binary").alias("text"))
    fps = to_batches(routed).mapInArrow(exactdedup._normalised_batches, "fp long, norm binary")
    held = common.share(spark, common.bit_filter(fps, "fp", 2))
    docs = spark.createDataFrame([("c o p y",)] * 3 + [(f"single {i}",) for i in range(500)], "text string")
    passed = to_batches(docs).mapInArrow(lambda it: exactdedup._normalised_batches(it, held), "fp long, norm binary").collect()
    assert sum(bytes(r.norm) == b"copy" for r in passed) == 3 and len(passed) <= 5


def test_token_counts_beyond_the_limit(spark, monkeypatch, tmp_dir):
    small = rows_of(tokencount.count_tokens(texts(spark)))
    monkeypatch.setattr(tokencount, "COPIES_BROADCAST_MAX", 0)
    cache = f"{tmp_dir}/cache"
    assert rows_of(tokencount.count_tokens(texts(spark), cache_path=cache)) == small
    stored = spark.read.parquet(cache)
    once = stored.groupBy("content").count().where("count > 1").count()
    assert once <= 1            # a content whose rows have no id is encoded for each
    n = stored.count()
    more = texts(spark).unionByName(spark.createDataFrame([(900, "new one", 1), (901, "copy 1  text", 1)], "doc_id long, text string, n int"))
    again = tokencount.count_tokens(more, cache_path=cache)
    assert again.count() == len(small) + 2
    assert spark.read.parquet(cache).count() == n + 1      # from the second run on: what is new


def test_few_texts_are_left_to_the_join(spark, monkeypatch):
    seen = {}
    real = tokencount._by_filters
    monkeypatch.setattr(tokencount, "COPIES_BROADCAST_MAX", 0)
    monkeypatch.setattr(tokencount, "_by_filters", lambda *a: seen.setdefault("r", real(*a)))
    tokencount.count_tokens(texts(spark)).count()
    clear, rest = (x.count() for x in seen["r"])
    assert clear >= 290 and rest <= 20        # 300 single texts at once; a row per group of copies
