"""Model jobs (rows + properties) and physical-plan checks."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tetrad import dims
from tetrad.operators import model, sampling, scoring
from tetrad.plans import fixtures as fx
from tetrad.plans import queries as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_save_load_same_scores(spark, tmp_dir):
    s = Q._labelled_split(spark, SF_SMALL)
    m = model.fit_16way(s.where("split = 'train'"), max_iter=5)
    path = model.model_path(tmp_dir, "raw", "16way")
    model.save(m, path)
    ev = s.where("split = 'eval'")
    a = model.score_16way(m, ev).select("post_id", "p")
    b = model.score_16way(model.load(path), ev).select("post_id", "p")
    assert a.exceptAll(b).count() == 0
    sums = a.select(F.aggregate("p", F.lit(0.0), lambda x, y: x + y).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    log = model.training_log(m)
    assert log[0][0] == 0 and log[-1][1] < log[0][1]      # iteration 0 is the untrained model


def test_model_learns_separable_toy(spark):
    rows = []
    for i in range(160):
        c = i % 16
        rows.append((i, f"word{c} " * 5 + "filler", dims.CLASS_NAMES[c].upper(), c))
    df = spark.createDataFrame(rows, "post_id long, posts string, type string, target int")
    df = model.with_model_input(df).withColumn("gold", F.lower("type"))
    m = model.fit_16way(df, max_iter=50)
    pred = scoring.predictions(model.score_16way(m, df))
    acc = pred.where("answer = gold").count() / 160
    assert acc > 0.9


def test_resample_keeps_text_out_of_shuffles(spark):
    df = sampling.resample(fx.posts(spark, SF_SMALL), dims.priors(spark, "prop"))
    df.collect()
    plan = _plan(df)
    # the wide rows meet the decision table in a broadcast join; the only exchange that carries text deals
    # out a single-split input, and none is by key
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [l for l in plan.splitlines() if "Exchange" in l and "posts" in l and "RoundRobin" not in l]


def test_ranking_needs_no_shuffle(spark):
    plan = _plan(Q.q_top5(spark, SF_SMALL))
    # only the round-robin spread of a single-split input file, no key shuffle
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert "Window" not in plan and "SinglePartition" not in plan


def test_split_scans_text_once(spark):
    df = sampling.train_eval_split(fx.posts(spark, SF_SMALL))
    df.collect()
    plan = _plan(df)
    # the wide (text) side is joined with a broadcast decision table, never shuffled by key
    assert "BroadcastHashJoin" in plan
    assert plan.split("+- == Initial Plan ==")[0].count("ReadSchema: struct<doc_id:bigint,text:string>") <= 1


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_plan_has_no_sort_merge_join(spark):
    plan = _executed(Q.q_train_eval_split(spark, SF_SMALL))
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_wordpiece_is_a_narrow_map(spark):
    from tetrad.operators import wordpiece
    words = spark.createDataFrame([("play",)], "w string")
    _, v, ids = Q._vocab(spark, SF_SMALL)
    plan = _executed(wordpiece.tokenize_words(words, v, ids=ids))
    assert "Exchange" not in plan and "Join" not in plan
    df = wordpiece.encode_posts(fx.posts(spark, SF_SMALL), v, ids=ids)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    # no join, no aggregate, one pass over the text
    assert "Join" not in logical and "Aggregate" not in logical
    assert logical.count("regexp_extract_all") == 1 and logical.count("Relation [doc_id") == 1


def test_large_inputs_are_not_spread(spark):
    from tetrad.sources.tables import spread
    df = spark.range(100, numPartitions=3)
    assert spread(df) is df
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_metrics_by_variant_is_one_pass(spark):
    df = Q.q_metrics_by_variant(spark, SF_SMALL)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Aggregate [variant") <= 1 + logical.count("InMemoryRelation")


def test_small_tables_are_given_up(spark):
    from tetrad.operators import rank
    for i in range(3 * rank.SMALL_KEPT):
        rank.small(spark.range(i + 1)).count()
    assert len(rank._kept) <= rank.SMALL_KEPT
    rank.release()
    assert not rank._kept


def test_variant_folder_is_new_each_time(spark):
    first = Q.q_variant_slice(spark, SF_SMALL)
    Q.q_variant_slice(spark, SF_SMALL)
    assert first.count() > 0


def test_scratch_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    import pytest

    from tetrad import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_logistic_models_learn(spark):
    """The fitted 16-way and axis models: rows, probabilities, and the log."""
    s = Q._labelled_split(spark, SF_SMALL)
    train = s.where("split = 'train'")
    feats, models = model.fit_axes(train, max_iter=5)
    scored = model.score_axes(feats, models, s.where("split = 'eval'"))
    assert scored.count() == s.where("split = 'eval'").count()
    assert scored.where("exists(p1, x -> x < 0 or x > 1) or size(p1) != 4").count() == 0


def test_prompted_input(spark):
    df = spark.createDataFrame([("a b c",)], "posts string")
    text = model.with_model_input(df, prompted=True).first().model_input
    assert text == dims.instruction(12) + "a b c\n[MBTI]\n"
