"""Labelled posts: CSV input, validation, rejects.

The reference reads a headered CSV of (posts, type) with pandas; identity
is the row position. Here the CSV is read with an explicit schema (quoted
fields, doubled quotes, embedded newlines) by many tasks a file
(:mod:`.csvranges`), with a stable ``post_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrad import dims
from tetrad.sources import csvranges

CORRUPT = "malformed"
CSV_SCHEMA = T.StructType([
    T.StructField("posts", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField(CORRUPT, T.StringType(), True),
])

# --- fixed values: fields that the reference's CSV reader takes for missing
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def content_id(posts: Column, label: Column, copy: Column) -> Column:
    """Id of a row from its content and its number among equal rows: an MD5 in
    hex, so that ids of any corpus differ."""
    return F.md5(F.concat(copy.cast("string"), F.lit("|"), _content(posts, label)))


def _content(posts: Column, label: Column) -> Column:
    """Label and text as one string that tells nulls from texts."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c)) for c in (label, posts)]
    return F.concat(parts[0], F.lit("|"), parts[1])


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(post_id, posts, type, malformed)`` from a headered CSV.

    Fields that the reference's reader takes for missing (an empty field
    among them) are null. A row that does not have two fields is kept whole in
    ``malformed``, and :func:`validate` rejects it. ``post_id`` depends on the
    row's content only, and for equal rows on their number, so it is the same
    however the files are split or named; equal rows meet by a digest of their
    content, as one row of each task."""
    df = csvranges.read_csv(spark, path, CSV_SCHEMA, CORRUPT)
    known = [F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in ("posts", "type")]
    rows = df.select(*known, CORRUPT)
    text = F.coalesce(F.col(CORRUPT), F.col("posts"))
    key = F.unhex(F.md5(F.concat(_content(text, F.col("type")), F.when(F.col(CORRUPT).isNull(), "").otherwise("!"))))
    rows = rows.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("posts", "type", CORRUPT)])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(content_id(text, F.col("type"), F.col("copy")).alias("post_id"), "posts", "type", CORRUPT)


def write_posts_csv(df: DataFrame, path: str) -> None:
    """Headered CSV like the reference's files: quotes doubled, values kept
    as they are (Spark trims leading/trailing spaces on write by default)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def with_label(posts: DataFrame, spark: SparkSession) -> DataFrame:
    """Normalize the type (trim, upper) and attach the class index by a
    broadcast join with the 16-row class table (P1, P2). Unknown types get
    a null ``target``."""
    cls = dims.classes(spark).select(F.upper("name").alias("_t"), F.col("idx").alias("target"))
    p = posts.withColumn("type", F.upper(F.trim(F.col("type"))))
    return p.join(F.broadcast(cls), p["type"] == cls["_t"], "left").drop("_t")


def validate(posts: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejects) instead of failing late.

    A post is rejected when its CSV row was malformed, its text is null or its
    type is not one of the 16 classes; ``reason`` names the first failing rule. Both outputs come
    from one lazy plan; write them in one job with a ``valid`` flag if the
    input is expensive.
    """
    lab = with_label(posts, spark)
    reason = F.when(F.col("posts").isNull(), F.lit("null_post"))
    if CORRUPT in posts.columns:
        lab = lab.withColumn("posts", F.coalesce(CORRUPT, "posts"))
        reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")).when(F.col("posts").isNull(), F.lit("null_post"))
    reason = (reason
              .when(F.col("target").isNull(), F.lit("unknown_type")))
    flagged = lab.withColumn("reason", reason)
    valid = flagged.where(F.col("reason").isNull()).drop("reason")
    rejects = flagged.where(F.col("reason").isNotNull()).select("post_id", "posts", "type", "reason")
    return valid, rejects
