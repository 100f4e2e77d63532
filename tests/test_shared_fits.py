"""Fits that share what they read: words counted once, weights kept off the driver."""

from pyspark.sql import functions as F

from tetrad import dims
from tetrad.operators import model


def rows(spark, n=64):
    data = [(i, f"word{i % 16} Word{i % 5} the, " * 2 if i % 9 else "", dims.CLASS_NAMES[i % 16], i % 16) for i in range(n)]
    data += [(3, "word1 again", "intp", 1), (3, "the the", "intp", 1)]          # ids may come twice
    return spark.createDataFrame(data, "post_id long, model_input string, gold string, target int")


def as_sorted(df):
    return sorted(map(str, df.collect()))


def test_letters_follow_from_the_classes_counts(spark):
    df = rows(spark)
    weights, priors = model.fit_axes_counts(df, model.count_words(df))
    for i in range(4):
        bit = df.withColumn("bit", F.shiftright("target", 3 - i).bitwiseAND(1))
        own, prior = model.fit_counts(bit, 2, "bit")
        assert priors[i] == prior
        assert as_sorted(own) == as_sorted(weights.select("w", F.col(f"lp{i}").alias("lp")))


def test_given_words_change_no_score(spark):
    df = rows(spark)
    counts, words = model.count_words(df), model.row_words(df)
    assert as_sorted(model.score_counts(model.fit_counts(df), df).select("post_id", "gold", F.transform("z", lambda z: F.round(z, 9)))) \
        == as_sorted(model.score_counts(model.fit_counts(df, counts=counts), df, words=words)
                     .select("post_id", "gold", F.transform("z", lambda z: F.round(z, 9))))
    p1 = model.score_axes_counts(model.fit_axes_counts(df, counts), df, words=words)
    assert p1.count() == 65 and p1.where("size(p1) != 4 or exists(p1, p -> p <= 0 or p >= 1)").count() == 0


def test_weights_are_not_broadcast(spark):
    """The words' weights grow with the corpus; broadcast, they pass the driver."""
    df = rows(spark)
    for scored in (model.score_counts(model.fit_counts(df), df), model.score_axes_counts(model.fit_axes_counts(df), df)):
        scored.collect()
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.split("Initial Plan")[0].count("SortMergeJoin") == 1


def test_texts_are_cut_once_for_all_logistic_fits(spark):
    """16-way and letters are fitted on the same features; each text is read once."""
    df, seen = rows(spark), spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text
    train = df.withColumn("model_input", F.udf(counted, "string")("model_input"))
    features = model.fit_features(train)
    m = model.fit_16way(train, max_iter=3, features=features)
    stages, models = model.fit_axes(train, max_iter=3, features=features)
    features.data.unpersist()
    assert seen.value == 66
    # rows with features are scored like texts; the fits equal those on features of their own
    ev = stages.transform(df).select("post_id", "gold", "features")
    a, b = (model.score_axes(*x, y) for x, y in (((stages, models), ev), (model.fit_axes(df, max_iter=3), df)))
    near = "post_id", "gold", F.transform("p1", lambda p: F.round(p, 6)).alias("p1")
    assert as_sorted(a.select(*near)) == as_sorted(b.select(*near))
    near = "post_id", "gold", F.transform("p", lambda p: F.round(p, 6)).alias("p")
    assert as_sorted(model.score_16way(m, ev).select(*near)) == as_sorted(model.score_16way(model.fit_16way(df, max_iter=3), df).select(*near))
