"""Text classifiers as Spark ML jobs.

The reference fine-tunes a transformer on one GPU. The distributed
equivalent here is a Spark ML pipeline - basic tokens, hashed term counts,
IDF, multinomial logistic regression - fitted by iterative Spark jobs and
applied with ``transform``. Model quality is not comparable with a
fine-tuned transformer; the data flow, outputs and metrics are.

- 16-way: one multinomial model, output = 16 probabilities (M1, M3);
- axes: four binary models over the same features, one per letter (M2);
- the training log is the optimizer's objective per iteration (M6);
- models are saved under a path that encodes variant and task (S6).
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import arrays as A
from tetrad.functions import text as T
from tetrad.session import materialize

NUM_FEATURES = 1 << 16   # model size: features x 16 classes, fixed


def feature_stages(input_col: str = "model_input"):
    tok = RegexTokenizer(inputCol=input_col, outputCol="_tokens", pattern=T.BASIC_TOKEN,
                         gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=NUM_FEATURES)
    idf = IDF(inputCol="_tf", outputCol="features")
    return [tok, tf, idf]


def with_model_input(posts: DataFrame, text_col: str = "posts", prompted: bool = False) -> DataFrame:
    """The model input (P6): the first max_length-10 words, or the prompt
    around the first max_length//2 words."""
    text = T.prompt(text_col, dims.MAX_LENGTH // 2, indent=12) if prompted else T.plain_input(text_col)
    return posts.withColumn("model_input", text)


class WordCounts(NamedTuple):
    """Training words with their count per class (``w, n0, n1, ..``) and the
    training rows per class."""
    words: DataFrame
    rows: list[int]


def count_words(train: DataFrame, n_classes: int = 16, label: str = "target", input_col: str = "model_input") -> WordCounts:
    """What the closed-form fits need of the training rows: the texts are cut
    into words once, whatever is fitted on the counts."""
    tok = train.select(F.col(label).alias("c"), F.explode(T.basic_tokens(input_col)).alias("w"))
    n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(n_classes)]
    words = materialize(tok.groupBy("w").agg(*n), "nb-words")
    rows = {r.c: r.n for r in train.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows without a class stand last
    return WordCounts(words, [*(rows.get(i, 0) for i in range(n_classes)), sum(n for c, n in rows.items() if c not in range(n_classes))])


def _closed_form(counts: WordCounts, groups: list[list[list[int]]]):
    """``(weights (w, lp ARRAY, ..), priors)``, one of each per entry of
    ``groups``, which says the counted classes that make up each of its classes."""
    names = counts.words.columns[1:]
    total = counts.words.agg(F.count(F.lit(1)).alias("v"), *[F.sum(n).alias(n) for n in names]).first()
    weights, priors = [], []
    for k, classes in enumerate(groups):
        lp = [F.log((sum((F.col(names[c]) for c in of), F.lit(0)) + 1) / F.lit(float(sum(total[names[c]] or 0 for c in of) + total["v"])))
              for of in classes]
        weights.append(F.array(*lp).alias(f"lp{k}"))
        priors.append([math.log((sum(counts.rows[c] for c in of) + 1) / (sum(counts.rows) + len(classes))) for of in classes])
    return counts.words.select("w", *weights), priors


def fit_counts(train: DataFrame, n_classes: int = 16, label: str = "target", input_col: str = "model_input",
               counts: WordCounts | None = None):
    """Closed-form fit (naive Bayes on basic tokens): ``(weights, prior)``.

    ``weights (w, lp ARRAY)``: per word and class ln((n + 1) / (N + V)), one
    aggregation; ``prior``: ln((rows + 1) / (all + classes)) per class, a list
    of ``n_classes`` numbers. Scores are exact arithmetic on counts, so another
    engine reproduces them. ``counts`` may give the counted words of ``train``."""
    weights, (prior,) = _closed_form(counts or count_words(train, n_classes, label, input_col), [[[c] for c in range(n_classes)]])
    return weights.withColumnRenamed("lp0", "lp"), prior


def row_words(df: DataFrame, keep: tuple = ("post_id", "gold"), input_col: str = "model_input") -> DataFrame:
    """``(keep..., w, n)``: word counts per row; a row without words has a null word."""
    return df.select(*keep, F.explode_outer(T.basic_tokens(input_col)).alias("w")) \
        .groupBy(*keep, "w").agg(F.count(F.lit(1)).alias("n"))


def _log_scores(weights: DataFrame, priors: list[list[float]], tok: DataFrame, keep: tuple) -> DataFrame:
    """``(keep..., z0, z1, ..)``: log scores per class, of each column of
    weights. The weights grow with the corpus, so they meet the rows' words in
    a shuffle: a broadcast would pass them through the driver."""
    j = tok.join(weights.hint("merge"), "w", "left")
    aggs, out = [], []
    for m, (lp, prior) in enumerate(zip(weights.columns[1:], priors, strict=True)):
        sums = [f"s{m}_{i}" for i in range(len(prior))]
        aggs += [F.sum(F.col("n") * F.element_at(lp, i + 1)).alias(s) for i, s in enumerate(sums)]
        out.append(F.array(*[F.coalesce(F.col(s), F.lit(0.0)) + F.lit(x) for s, x in zip(sums, prior)]).alias(f"z{m}"))
    return j.groupBy(*keep).agg(*aggs).select(*keep, *out)


def score_counts(model, df: DataFrame, keep: tuple = ("post_id", "gold"), input_col: str = "model_input",
                 words: DataFrame | None = None) -> DataFrame:
    """``(keep..., z ARRAY, p ARRAY)``: log scores per class (words not seen in
    training count nothing) and their softmax. Word counts per row join the
    weights by word, then sum per row. ``words`` may give the row words of ``df``."""
    weights, prior = model
    tok = row_words(df, keep, input_col) if words is None else words
    return _log_scores(weights, [prior], tok, keep).withColumnRenamed("z0", "z").withColumn("p", A.softmax("z"))


#: log weights are kept as whole numbers of this many parts
SCALE = 1_000_000


class BucketModel(NamedTuple):
    """Whole-number log weights per (word bucket, class) and per class."""
    weights: np.ndarray
    prior: np.ndarray
    digits: int


def fit_buckets(train: DataFrame, n_classes: int = 16, label: str = "target", input_col: str = "model_input",
                digits: int = 3) -> BucketModel:
    """The closed-form fit over word buckets, the first ``digits`` hex digits of
    a word's md5: floor(SCALE * ln((n + 1) / (N + buckets))). Its size does not
    grow with the corpus (16**digits x classes numbers, made on the driver from
    as many counts), so it can go to every task; sums of whole numbers are
    equal in any order."""
    buckets = 16 ** digits
    bucket = F.transform(T.basic_tokens(input_col), lambda w: F.conv(F.substring(F.md5(w), 1, digits), 16, 10).cast("int"))
    tok = train.select(F.col(label).alias("c"), F.explode(bucket).alias("b"))
    counts = tok.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = np.zeros((buckets, n_classes), np.int64)
    n[counts["b"].to_numpy(), counts["c"].to_numpy()] = counts["n"].to_numpy()
    rows = {r.c: r.n for r in train.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.floor(SCALE * np.log((n + 1) / (n.sum(0) + buckets))).astype(np.int32)
    shares = [(rows.get(i, 0) + 1) / (sum(rows.values()) + n_classes) for i in range(n_classes)]
    return BucketModel(weights, np.floor(SCALE * np.log(shares)).astype(np.int64), digits)


def fit_axes_counts(train: DataFrame, counts: WordCounts | None = None):
    """Four closed-form two-class fits, one per letter (M2): ``(weights (w, lp0
    ARRAY, .., lp3 ARRAY), priors)``. A letter's counts are sums of the classes'
    counts, so the words are counted once; ``counts`` may give them."""
    letters = [[[c for c in range(16) if c >> (3 - i) & 1 == bit] for bit in (0, 1)] for i in range(4)]
    return _closed_form(counts or count_words(train), letters)


def score_axes_counts(models, df: DataFrame, keep: tuple = ("post_id", "gold"), words: DataFrame | None = None) -> DataFrame:
    """``(keep..., p1 ARRAY<DOUBLE>(4))`` of the closed-form axis models, all
    in one pass over the words. Rows with a null key are left out."""
    weights, priors = models
    tok = (row_words(df, keep) if words is None else words).dropna(subset=list(keep))
    z = _log_scores(weights, priors, tok, keep)
    return z.select(*keep, F.array(*[F.element_at(A.softmax(f"z{i}"), 2) for i in range(len(priors))]).alias("p1"))


class Features(NamedTuple):
    """Fitted feature stages and the training rows' features, persisted, with
    the label of the 16-way task and of each letter."""
    stages: PipelineModel
    data: DataFrame


def fit_features(train: DataFrame) -> Features:
    """Feature stages fitted on ``(model_input, target)``, for any number of
    fits. The texts are cut into terms once and kept as term counts, from which
    the IDF and the features follow. Rows are dealt to whole waves of tasks, as
    each optimizer step waits for the last one and every task sends a gradient.
    Features stay on disk, as each fit reads them twice and then keeps blocks of
    its own in memory. The caller unpersists ``data``."""
    tok, tf, idf = feature_stages()
    terms = tf.transform(tok.transform(train)).select("_tf", "target")
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, terms.rdd.getNumPartitions() // cores) * cores
    terms = materialize(terms, "terms")
    idf = idf.fit(terms)
    target = F.col("target")
    letters = [F.shiftright(target, 3 - i).bitwiseAND(1).cast("double").alias(f"label{i}") for i in range(4)]
    data = idf.transform(terms).select("features", target.cast("double").alias("label"), *letters)
    return Features(PipelineModel([tok, tf, idf]), data.repartition(tasks).persist(StorageLevel.DISK_ONLY))


def fit_16way(train: DataFrame, max_iter: int = 30, reg: float = 0.01, features: Features | None = None) -> PipelineModel:
    """Fit tokens -> TF-IDF -> multinomial LR on ``(model_input, target)``.
    ``features`` may give the features of ``train``."""
    lr = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                            maxIter=max_iter, regParam=reg, probabilityCol="_prob")
    own = features or fit_features(train)
    try:
        return PipelineModel(own.stages.stages + [lr.fit(own.data)])
    finally:
        if features is None:
            own.data.unpersist()


def score_16way(model: PipelineModel, df: DataFrame, keep: tuple = ("post_id", "gold")) -> DataFrame:
    """``(keep..., p ARRAY<DOUBLE>(16))`` - the wide score form (M3). Rows that
    have their features are scored from these."""
    out = (model.stages[-1] if "features" in df.columns else model).transform(df)
    return out.select(*keep, vector_to_array("_prob").alias("p"))


def training_log(model: PipelineModel) -> list[tuple[int, float]]:
    """(iteration, objective) of the fitted LR (M6); the driver-side history
    of a fitted model, a few dozen values. Iteration 0 is the untrained model;
    the objective is the regularised loss."""
    lr = model.stages[-1]
    return list(enumerate(lr.summary.objectiveHistory))


def fit_axes(train: DataFrame, max_iter: int = 30, reg: float = 0.01, features: Features | None = None):
    """Four binary models, one per letter, over one feature pipeline (M2).
    The features are computed once and persisted for the four fits (a
    cache is recomputed from the stored terms if an executor is lost).
    ``features`` may give the features of ``train``."""
    own = features or fit_features(train)
    models = []
    try:
        for i in range(4):
            # the persisted frame itself: of a frame derived from it, every fit would cache its rows anew
            lr = LogisticRegression(featuresCol="features", labelCol=f"label{i}", family="binomial",
                                    maxIter=max_iter, regParam=reg, probabilityCol=f"_prob{i}",
                                    rawPredictionCol=f"_raw{i}", predictionCol=f"_pred{i}")
            models.append(lr.fit(own.data))
    finally:
        if features is None:
            own.data.unpersist()
    return own.stages, models


def score_axes(feats: PipelineModel, models, df: DataFrame,
               keep: tuple = ("post_id", "gold")) -> DataFrame:
    """``(keep..., p1 ARRAY<DOUBLE>(4))``: P(second letter) per axis. Rows that
    have their features are scored from these."""
    out = df if "features" in df.columns else feats.transform(df)
    for m in models:
        out = m.transform(out)
    p1 = F.array(*[vector_to_array(f"_prob{i}")[1] for i in range(4)])
    return out.select(*keep, p1.alias("p1"))


def model_path(root: str, variant: str, task: str) -> str:
    """Where a fitted model lives: one folder per (variant, task)."""
    return f"{root.rstrip('/')}/{task}-{variant}"


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def log_frame(spark: SparkSession, log: list[tuple[int, float]], secs: float = 0.0, save_secs: float = 0.0) -> DataFrame:
    """The training log as ``(iteration, objective, secs, ckpt_secs)`` rows:
    the fit's and the save's time, spread evenly over the iterations."""
    n = max(1, len(log) - 1)
    return spark.createDataFrame([(int(e), float(v), secs / n, save_secs / n) for e, v in log],
                                 "iteration int, objective double, secs double, ckpt_secs double")
