"""Properties of the dataset, ranking and metric operators."""

import math

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tetrad import dims
from tetrad.operators import metrics, rank, sampling, scoring
from tetrad.plans import fixtures as fx
from tetrad.plans import queries as Q


def test_split_is_exact_and_disjoint(spark):
    p = fx.post_types(spark, SF_MID)
    s = sampling.train_eval_split(p, ratio=0.9).cache()
    n = p.count()
    tr = s.where("split = 'train'").select("post_id")
    ev = s.where("split = 'eval'").select("post_id")
    assert tr.count() == math.floor(n * 0.9)
    assert tr.intersect(ev).count() == 0
    assert tr.union(ev).distinct().count() == n


def test_split_independent_of_partitioning(spark):
    p = fx.post_types(spark, SF_MID)
    a = sampling.train_eval_split(p).select("post_id", "split")
    b = sampling.train_eval_split(p.repartition(13)).select("post_id", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_resample_matches_plan(spark):
    p = fx.post_types(spark, SF_MID)
    for v in ("bal", "prop"):
        plan = {r["type"]: r["sample_cnt"] for r in
                sampling.resample_plan(p, dims.priors(spark, v)).collect()}
        got = {r["type"]: r["count"] for r in
               sampling.resample(p, dims.priors(spark, v)).groupBy("type").count().collect()}
        assert got == plan


def test_missing_prior_raises(spark):
    import pytest
    p = fx.post_types(spark, SF_MID)
    prior = dims.priors(spark, "prop").where("type != 'ESTP'")
    with pytest.raises(Exception, match="no prior for type ESTP"):
        sampling.resample_plan(p, prior).collect()


def test_exact_rank_equals_global_row_number(spark):
    from pyspark.sql import Window
    p = fx.post_types(spark, SF_MID).withColumn("k", rank.hash_key("post_id", 7))
    a = rank.exact_rank(p, "k", "post_id", digits=2).select("post_id", "rank")
    b = p.select("post_id", F.row_number().over(Window.orderBy("k", "post_id")).alias("rank"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_first_n_with_duplicate_keys(spark):
    """Ties in the key are broken by the tie column, exactly."""
    df = spark.range(0, 500).select(F.col("id"), F.lit("00ab").alias("k"))
    cut = spark.createDataFrame([(123,)], "cut long")
    kept = rank.first_n(df, "k", "id", cut).select("id")
    assert sorted(r.id for r in kept.collect()) == list(range(123))


def test_hits_monotone_and_histogram_sums(spark):
    m = Q.q_metrics_16way(spark, SF_MID).first()
    assert m.hit_3 <= m.hit_5 <= m.hit_10 <= 100
    h = Q.q_match_histogram(spark, SF_MID).collect()
    assert sorted(r.k for r in h) == [0, 1, 2, 3, 4]
    assert sum(r.exactly_k_correct for r in h) == m.n


def test_bits_round_trip(spark):
    rows = Q.q_axis_bits(spark, SF_MID).collect()
    assert all(r.target == r.idx_back for r in rows)
    assert {r.bits for r in rows} <= {format(i, "04b") for i in range(16)}


def test_probabilities_sum_to_one(spark):
    p = scoring.with_probs(fx.scores(spark, SF_MID))
    bad = p.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1.0) > 1e-9).count()
    assert bad == 0


def test_padded_batches_equal_lengths(spark):
    from tetrad.operators import batching
    rows = Q._token_labels(spark, SF_MID).cache()
    kinds = {r.n_supervised > 0 for r in rows.select("n_supervised").distinct().collect()}
    assert kinds == {True, False}            # some rows keep their target, some lose it
    p = batching.pad_batches(batching.with_batch(rows, Q._train_batches(spark, SF_MID)), "input_ids")
    per = p.groupBy("batch_id").agg(F.countDistinct(F.size("padded")).alias("d"),
                                    F.count(F.lit(1)).alias("n"))
    assert per.where("d != 1 OR n != 64").count() == 0


def test_metrics_bounds(spark):
    m = Q.q_metrics_axes(spark, SF_MID).first()
    for c in ("accuracy", "mean_match", "letter_0", "letter_1", "letter_2", "letter_3"):
        assert 0 <= m[c] <= 100


def test_resample_variants_equals_one_prior_at_a_time(spark):
    p = fx.post_types(spark, SF_MID)
    both = sampling.resample_variants(p, dims.priors(spark)).select("variant", "post_id")
    for v in ("bal", "prop"):
        one = sampling.resample(p, dims.priors(spark, v)).select("post_id")
        mine = both.where(F.col("variant") == v).select("post_id")
        assert one.exceptAll(mine).count() == 0 and mine.exceptAll(one).count() == 0


def test_marker_sessions_with_a_hot_user(spark):
    """A third of all events belong to one user: the two-level count still
    equals the plain per-user running sum."""
    from pyspark.sql import Window
    from tetrad.operators import sessions
    e = fx.marked_events(spark, SF_MID).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    got = sessions.marker_sessions(e).select("event_id", "session_no")
    w = (Window.partitionBy("user_id").orderBy("ts", "event_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    want = e.select("event_id", F.coalesce(F.sum(F.col("is_stop").cast("long")).over(w),
                                            F.lit(0)).alias("session_no"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
