"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies,
target / size of the source. Documents stand in order of size (then of a hash
of their id), their expected copies are prefix-summed, one offset per source is
added, and a document is emitted once for every integer that its part of the
sum crosses. The order by size makes the words taken come near the target.

The prefix sum has three levels, so that no window holds a hot source: sizes
within a source, 256 hash parts within a size, rows within a part.

Defined cases: a null text has size 0, and is never emitted if all of its
source is empty. A null source is a source of its own, after all others. A null
doc_id counts as id '' in the hash. Repeated rows are separate documents. An
empty table gives an empty result. The table of sources itself is small: its
weights are given by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrad.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: the most times that a source, and so a document, is repeated
MAX_REPEAT = 3
SEED = "mix-1"


def words_in(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, size: Column) -> DataFrame:
    """The rows as a struct, and the keys of the prefix sum."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"),
        size.alias("size"),
        F.substring(F.md5(doc_id.cast("binary")), 1, 2).alias("part"))


def targets(sizes: DataFrame) -> DataFrame:
    """Target and copies per document of each source.

    ``sizes`` has a row per (no_source, src) with its ``source_size``. Sources
    in order weigh 1, 2, 3, 1, ...; a target never exceeds MAX_REPEAT times the
    size. In order of size per weight the sources that meet this limit come
    first, so the common level (words per weight) of the others is the largest
    of the levels left after each.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("no_source", "src")
    by_ratio = Window.orderBy("ratio", "no_source", "src")
    t = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1) \
        .withColumn("total", F.sum("source_size").over(everything)) \
        .withColumn("limit", F.col("source_size") * MAX_REPEAT) \
        .withColumn("ratio", F.col("limit").cast("double") / F.col("w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("w"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.col("no_source").cast("string"), F.lit(":"),
                                               F.col("src")).cast("binary")), 1, 8), 16, 10).cast("double")
    return t.select("no_source", "src", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("copies_each"),
                    (offset / F.lit(4294967296.0)).alias("offset"))


def assign_copies(docs: DataFrame, size: Column) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with id, size, source_size,
    target and the number of ``copies`` that the mix takes."""
    rows = _keyed(docs, size)
    src, part = ["no_source", "src"], ["no_source", "src", "size", "part"]
    counts = materialize(rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = counts.groupBy(*src).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(sizes)

    def before(*keys, order):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    by_size = counts.groupBy(*src, "size").agg(F.sum("n").alias("n")) \
        .select(*src, "size", before(*src, order="size").alias("a"))
    starts = counts.withColumn("b", before(*src, "size", order="part")) \
        .join(by_size, [*src, "size"]).join(plan, src) \
        .select(*part, (F.col("a") + F.col("b")).alias("start"), "source_size", "target", "copies_each", "offset")
    place = F.col("start") + F.row_number().over(Window.partitionBy(*part).orderBy(F.col("id").asc_nulls_last()))

    def crossed(k):
        return F.floor(k * F.col("copies_each") + F.col("offset"))

    out = rows.join(starts, part).withColumn("place", place)
    return out.select("row", "id", "size", "source_size", "target",
                      (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per document."""
    narrow = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    out = assign_copies(narrow, F.col("size"))
    return out.select(F.col("id").alias("doc_id"), F.col("row.source").alias("source"), "size", "source_size",
                      "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it."""
    out = assign_copies(docs, words_in(F.col("text"))).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
