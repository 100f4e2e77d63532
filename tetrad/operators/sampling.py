"""Class counts, resampling to a class prior, exact train/eval split.

Reference semantics (dataset builder):

- counts = non-null posts per type; a type in the data without a prior is
  an error (the reference fails on the NaN it produces);
- maximal_count = floor(min(count / frac)) over the types present;
- sample_cnt = floor(frac * maximal_count) per type (the sum may fall a
  little short of maximal_count: kept as is);
- each class is sampled without replacement (here: the ``sample_cnt`` rows
  with the smallest md5 key, tie by id - an exact, reproducible draw);
- the split keeps floor(n * ratio) rows of the whole set for training,
  again without replacement, and the rest for evaluation.

Everything is planned on the small per-class / per-bucket tables, which are
broadcast; rows are never sorted whole (see :mod:`tetrad.operators.rank`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.operators.rank import KEY, apply_cut, cut_decision, first_n, hash_key

DEFAULT_SEED = 2
TRAIN_RATIO = 0.9


def has_text(posts: DataFrame) -> Column:
    """Whether a post has its text: from the text itself, or, on a frame of
    ids, from the flag ``has_text`` that it must carry."""
    if "posts" in posts.columns:
        return F.col("posts").isNotNull()
    if "has_text" in posts.columns:
        return F.col("has_text")
    raise ValueError("a frame without the column posts needs the flag has_text")


def class_counts(posts: DataFrame) -> DataFrame:
    """``(type, posts)``: non-null posts per type (A1), the same with the
    text and on an id-only frame with the flag ``has_text``."""
    return posts.groupBy("type").agg(F.count_if(has_text(posts)).alias("posts"))


def resample_plan(posts: DataFrame, prior: DataFrame) -> DataFrame:
    """Allocation per class.

    ``prior`` has columns (type, real_frac). Returns
    ``(type, posts, real_frac, maximal_count, sample_cnt)``; 16 rows at most.
    """
    counts = class_counts(posts)
    j = counts.join(F.broadcast(prior.select("type", "real_frac")), "type", "left")
    j = j.withColumn("real_frac", F.when(
        F.col("real_frac").isNull(),
        F.raise_error(F.concat(F.lit("no prior for type "), F.col("type")))
    ).otherwise(F.col("real_frac")).cast("double"))
    # the plan has one row per class (16): a window over all of it is cheap
    mx = F.floor(F.min(F.col("posts").cast("double") / F.col("real_frac"))
                 .over(Window.partitionBy())).cast("long")
    return (j.withColumn("maximal_count", mx)
            .withColumn("sample_cnt",
                        F.floor(F.col("real_frac") * F.col("maximal_count").cast("double"))
                        .cast("long")))


def resample(posts: DataFrame, prior: DataFrame, seed: int = DEFAULT_SEED,
             id_col: str = "post_id", digits: int = 3) -> DataFrame:
    """Exact stratified sample without replacement to a class prior.

    Per type, keeps the ``sample_cnt`` rows with the smallest
    ``md5('<id>:<seed>')`` (tie by id). Adds ``order_key``.
    """
    posts = posts.where(has_text(posts))
    plan = resample_plan(posts, prior).select("type", F.col("sample_cnt").alias("cut"))
    keyed = posts.withColumn(KEY, hash_key(id_col, seed))
    return first_n(keyed, KEY, id_col, plan, groups=["type"], digits=digits)


def resample_variants(posts: DataFrame, priors: DataFrame, seed: int = DEFAULT_SEED,
                      id_col: str = "post_id", digits: int = 3) -> DataFrame:
    """W1 for several priors at once: ``priors (variant, type, real_frac)``.

    All variants draw with the same key, so the per-(class, bucket) counts
    and the edge-bucket sort are shared; the decision table is keyed by
    (variant, class, bucket). The decision is joined by (class, bucket), so a
    post is copied only for the variants whose cut its bucket reaches."""
    posts = posts.where(has_text(posts))
    counts = class_counts(posts)
    j = counts.join(F.broadcast(priors.select("variant", "type", "real_frac")), "type", "left")
    j = j.withColumn("real_frac", F.when(
        F.col("real_frac").isNull(),
        F.raise_error(F.concat(F.lit("no prior for type "), F.col("type")))
    ).otherwise(F.col("real_frac")).cast("double"))
    mx = F.floor(F.min(F.col("posts").cast("double") / F.col("real_frac"))
                 .over(Window.partitionBy("variant"))).cast("long")
    cuts = j.select("variant", "type", F.floor(F.col("real_frac") * mx.cast("double"))
                    .cast("long").alias("cut"))
    keyed = posts.withColumn(KEY, hash_key(id_col, seed))
    decision = cut_decision(keyed.select("type", KEY, id_col), KEY, id_col, cuts, ["type"], digits)
    return apply_cut(keyed, KEY, id_col, decision, ["type"], digits)


def resample_both(posts: DataFrame, priors: DataFrame, seed: int = DEFAULT_SEED,
                  id_col: str = "post_id", digits: int = 3) -> DataFrame:
    """Both resampling flags: to the proportional prior, and that sample to
    the balanced one. Carries the name ``prop``, like the reference's file."""
    first = resample(posts, priors.where("variant = 'prop'"), seed, id_col, digits).drop(KEY)
    return resample(first, priors.where("variant = 'bal'"), seed, id_col, digits).withColumn("variant", F.lit("prop"))


def split_key(id_col: str = "post_id", seed: int = DEFAULT_SEED):
    return hash_key(id_col, seed, salt="split:")


def train_eval_split(df: DataFrame, ratio: float = TRAIN_RATIO, seed: int = DEFAULT_SEED,
                     id_col: str = "post_id", groups: tuple = (), digits: int = 3) -> DataFrame:
    """Exact random split (T2): ``split`` = 'train' for floor(n * ratio) rows
    of each group (smallest ``md5('<id>:split:<seed>')``), else 'eval'.
    Adds ``split_key``. Not ``randomSplit`` (inexact, partition dependent)."""
    keyed = df.withColumn("split_key", split_key(id_col, seed))
    out = first_n(keyed, "split_key", id_col, float(ratio), groups=list(groups), digits=digits,
                  flag_col="_train")
    return (out.withColumn("split", F.when(F.col("_train"), F.lit("train"))
                           .otherwise(F.lit("eval"))).drop("_train"))


def dataset_variants(spark: SparkSession, posts: DataFrame, seed: int = DEFAULT_SEED,
                     id_col: str = "post_id", ratio: float = TRAIN_RATIO) -> DataFrame:
    """All three dataset variants with their split (E1, U3):
    ``variant`` in raw / bal / prop, ``split`` in train / eval. Posts without
    text are in none."""
    posts = posts.where(has_text(posts))
    raw = posts.withColumn("variant", F.lit("raw"))
    sampled = resample_variants(posts, dims.priors(spark), seed=seed, id_col=id_col).drop(KEY)
    allv = raw.unionByName(sampled)
    return train_eval_split(allv, ratio=ratio, seed=seed, id_col=id_col, groups=("variant",))
