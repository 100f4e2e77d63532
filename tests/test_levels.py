"""Prefix sums in levels: ranks with many digits, transcripts by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tetrad.operators import rank, sessions
from tetrad.plans import fixtures as fx
from tetrad.streaming.transcript import _append


@pytest.mark.parametrize("digits", [4, 7])
def test_ranks_in_levels_equal_those_of_one_level(spark, digits):
    ids = fx.posts(spark, SF_SMALL).select("post_id", (F.col("post_id") % 3).alias("g")).withColumn("k", rank.hash_key("post_id", 1))
    want = rank.exact_rank(ids, "k", "post_id", ["g"], total_col="n")
    got = rank.exact_rank(ids, "k", "post_id", ["g"], digits=digits, total_col="n")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    got = rank.exact_rank(ids, "k", "post_id", digits=digits)
    want = rank.exact_rank(ids, "k", "post_id")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_offsets_of_many_digits_are_not_forced_to_all_workers(spark):
    ids = fx.posts(spark, SF_SMALL).select("post_id").withColumn("k", rank.hash_key("post_id", 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rank.exact_rank(ids, "k", "post_id", digits=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 2          # ids and offsets by bucket; the window needs no other


def _turns(seed, n, sessions_):
    rng = random.Random(seed)
    texts = [None, "", " ", "he", "llo", "a b ", " c", ".", "x.y", "é", "word word"]
    return [(rng.choice(sessions_), t, rng.choice(texts)) for t in range(n)]


@pytest.mark.parametrize("sep", ["", " ", "-"])
@pytest.mark.parametrize("max_tokens", [None, 1, 5, 40])
def test_transcripts_by_blocks_equal_plain_joins(spark, monkeypatch, sep, max_tokens):
    monkeypatch.setattr(sessions, "BLOCK_TURNS", 8)
    rows = _turns(4, 300, [1, 1, 1, 2, None]) + [(3, -5, "neg"), (3, 9, None), (4, 2, None)]
    want, seen = [], {}
    for s, t, x in sorted(rows, key=lambda r: r[1]):
        parts = seen.setdefault(s, [])
        if x is not None:
            parts.append(x)
        text = sep.join(parts)
        if max_tokens is not None:
            text = _append("", text, "", 0, False, max_tokens)[0]
        want.append((s, t, text))
    u = spark.createDataFrame(rows, "session_id long, turn long, text string")
    got = sessions.running_transcript(u, sep=sep, max_tokens=max_tokens).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def _hot(spark):
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("turn"), F.lit("w ").alias("text"))
    rest = spark.range(6000).select((F.col("id") % 500 + 2).alias("session_id"), F.col("id").alias("turn"), F.lit("w ").alias("text"))
    return hot.union(rest)


def test_a_hot_session_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sessions.running_transcript(_hot(spark)).where("session_id = 1")
        n = [r["count"] for r in out.where(F.length("transcript") > 0).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(n) == 3000 and len(n) >= 4 and max(n) <= 1536      # 12 blocks over 8 tasks


def test_no_text_is_built_for_turns_past_the_cap(spark, monkeypatch):
    seen, plain = [], sessions._prefix_texts

    def counting(d, *a):
        seen.append(d.where("_s = 1").count())
        return plain(d, *a)
    monkeypatch.setattr(sessions, "_prefix_texts", counting)
    out = sessions.running_transcript(_hot(spark), max_tokens=20)
    assert seen == [21]
    assert out.where("session_id = 1 and turn >= 19 and length(transcript) = 39").count() == 3000 - 19
    assert out.count() == 9000
