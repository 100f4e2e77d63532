"""Exact distributed rank and exact top-n cut without a global sort (H1).

A ``row_number()`` window with no partition key moves every row into one
task. Instead each row gets a *hash key* (hex md5 of id and seed) and a
*bucket* (the first ``digits`` hex characters of it). The per-bucket counts
form a small table - at most ``groups x 16**digits`` rows, where groups is
a bounded dimension such as the 16 classes or the 3 dataset variants - so
its running sum is cheap and it is broadcast back:

    rank = rows_before(bucket) + row_number() over (partition by group, bucket
                                                    order by key, tie)

equals the global ``row_number() over (partition by group order by key,
tie)``. A class that holds a third of all rows is still spread over
``16**digits`` buckets.

For a *cut* (keep the first ``cut`` rows of each group) no row needs its
rank: buckets wholly below the cut are kept, buckets wholly above are
dropped, and in the one bucket per group that straddles the cut only the
(key, tie) of the last kept row is needed. That threshold table has at most
one row per group, so the decision is a broadcast join on (group, bucket)
plus a comparison - the wide input is scanned once and never shuffled.
Only the ids of the straddling buckets (~1/16**digits of the rows) are
sorted to find the thresholds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrad.session import materialize

KEY = "order_key"
BUCKET = "_bkt"


def hash_key(id_col: str | Column, seed: int | str, salt: str = "") -> Column:
    """Reproducible pseudo-random key: ``md5('<id>:<salt><seed>')``.

    md5 gives the same hex string in Spark and in SQL engines, unlike
    ``rand()`` or ``xxhash64``, so the draw can be checked by an oracle.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{salt}{seed}")))


#: small tables kept in memory at a time; older ones are given up
SMALL_KEPT = 16
_kept: deque[DataFrame] = deque()


def small(df: DataFrame) -> DataFrame:
    """Cache a table that is small by construction (bucket counts,
    decisions: at most groups x 16**digits rows) so that every plan that
    refers to it reads it once computed; a lost block, or one given up, is
    recomputed from its short lineage."""
    _kept.append(df.cache())
    while len(_kept) > SMALL_KEPT:
        _kept.popleft().unpersist()
    return df


def release() -> None:
    """Give up all kept tables."""
    while _kept:
        _kept.popleft().unpersist()


#: rows that a bucket of the rank should hold at most
BUCKET_ROWS = 250_000


def digits_for(rows: int) -> int:
    """Hex digits that keep ``rows`` ids at BUCKET_ROWS per bucket; 3 at least."""
    d = 3
    while rows / 16 ** d > BUCKET_ROWS:
        d += 1
    return d


def bucket_of(key: str, digits: int) -> Column:
    return F.substring(F.col(key), 1, digits)


#: hex digits that one level of the prefix sum takes: at most 4,096 rows a window
LEVEL = 3


def _prefix_sums(counts: DataFrame, groups: Sequence[str], digits: int) -> DataFrame:
    """``counts(groups, _bkt, _n)`` with ``_before`` and the group's ``_total``.
    Buckets of more than LEVEL digits are summed level by level: within their
    shared first digits, plus what stands before these."""
    if digits <= LEVEL:
        over = Window.partitionBy(*groups)
        w = over.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long")) \
            .withColumn("_total", F.sum("_n").over(over))
    keys = [*groups, "_up"]
    counts = counts.withColumn("_up", F.substring(BUCKET, 1, digits - LEVEL))
    ups = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).withColumnRenamed("_up", BUCKET)
    ups = _prefix_sums(ups, groups, digits - LEVEL).select(
        *groups, F.col(BUCKET).alias("_up"), F.col("_before").alias("_upper"), "_total")
    w = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(ups, keys) \
        .withColumn("_before", (F.col("_upper") + F.col("_in")).cast("long")).drop("_up", "_upper", "_in")


def bucket_offsets(keys: DataFrame, key: str, groups: Sequence[str], digits: int) -> DataFrame:
    """``(groups, _bkt, _n, _before, _total)``: rows per bucket, rows in earlier
    buckets of the same group and rows of the group: groups x 16**digits rows."""
    counts = (keys.groupBy(*groups, bucket_of(key, digits).alias(BUCKET))
              .agg(F.count(F.lit(1)).alias("_n")))
    if digits > LEVEL:
        counts = materialize(counts, "rank-counts")
    return _prefix_sums(counts, groups, digits)


def exact_rank(df: DataFrame, key: str, tie: str, groups: Sequence[str] = (),
               digits: int = 3, rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in (key, tie) order
    within ``groups`` (and, with ``total_col``, the group's row count).
    ``key`` must be a hex string column (see :func:`hash_key`); ``groups``
    must be a bounded dimension. Offsets of up to LEVEL digits are broadcast (at
    most 4,096 rows a group); of more they are joined by bucket, with the
    shuffle that the ranking inside buckets needs anyway."""
    groups = list(groups)
    offsets = bucket_offsets(df.select(*groups, key), key, groups, digits).drop("_n")
    offsets = F.broadcast(small(offsets)) if digits <= LEVEL else materialize(offsets, "rank-offsets")
    w = Window.partitionBy(*groups, BUCKET).orderBy(F.col(key), F.col(tie))
    out = (df.withColumn(BUCKET, bucket_of(key, digits))
           .join(offsets, [*groups, BUCKET])
           .withColumn(rank_col, F.col("_before") + F.row_number().over(w)))
    if total_col:
        out = out.withColumnRenamed("_total", total_col)
    return out.drop(BUCKET, "_before", "_total")


def cut_decision(keys: DataFrame, key: str, tie: str, cut: DataFrame | int | float,
                 groups: Sequence[str], digits: int = 3) -> DataFrame:
    """Decision table for keeping the first ``cut`` rows per group.

    ``keys`` holds the groups, key and tie columns (ids only). ``cut`` is a
    small frame with one row per group (groups + ``cut``), an ``int`` (the
    same count for every group) or a ``float`` ratio: cut = floor(rows in
    the group * ratio). A cut frame may carry extra key columns (e.g. one
    cut per prior variant and class): the bucket counts are shared and the
    decision is keyed by the extra columns too. Returns ``(groups, _bkt,
    _state, _thr_key, _thr_tie)`` with ``_state`` in all / edge (buckets
    wholly above the cut are left out); at most one edge row per group.

    The table is tiny (< groups x 16**digits rows), cached and broadcast:
    however often a plan refers to it, the ids are aggregated once.
    """
    groups = list(groups)
    offsets = bucket_offsets(keys, key, groups, digits)
    if isinstance(cut, DataFrame) and not groups:
        cut = int(cut.first()["cut"])   # one number, no keyless join
    extra = []
    if isinstance(cut, DataFrame):
        extra = [c for c in cut.columns if c not in groups and c != "cut"]
        offsets = offsets.join(F.broadcast(cut), groups)
    elif isinstance(cut, int):
        offsets = offsets.withColumn("cut", F.lit(cut).cast("long"))
    else:
        offsets = offsets.withColumn("cut", F.floor(F.col("_total").cast("double") * F.lit(float(cut)))
                                     .cast("long"))
    state = (F.when(F.col("_before") + F.col("_n") <= F.col("cut"), F.lit("all"))
             .when(F.col("_before") >= F.col("cut"), F.lit("none"))
             .otherwise(F.lit("edge")))
    offsets = small(offsets.select(*extra, *groups, BUCKET, "_before", "cut", state.alias("_state"))
                    .where(F.col("_state") != "none"))
    edge = offsets.where(F.col("_state") == "edge")
    w = Window.partitionBy(*extra, *groups, BUCKET).orderBy(F.col(key), F.col(tie))
    thr = (keys.withColumn(BUCKET, bucket_of(key, digits))
           .join(F.broadcast(edge), [*groups, BUCKET])   # ~1/16**digits of ids, per cut
           .withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") == F.col("cut") - F.col("_before"))
           .select(*extra, *groups, BUCKET, F.col(key).alias("_thr_key"),
                   F.col(tie).alias("_thr_tie")))
    return small(offsets.select(*extra, *groups, BUCKET, "_state")
                 .join(F.broadcast(thr), [*extra, *groups, BUCKET], "left"))


def apply_cut(df: DataFrame, key: str, tie: str, decision: DataFrame,
              groups: Sequence[str], digits: int = 3, flag_col: str | None = None) -> DataFrame:
    """Keep (or, with ``flag_col``, flag) the rows selected by a
    :func:`cut_decision`. One broadcast join; no shuffle of ``df``."""
    how = "left" if flag_col else "inner"
    bkt = bucket_of(key, digits)
    if not groups:
        # a single global group: the decision is keyed by bucket only
        j = df.withColumn(BUCKET, bkt).join(F.broadcast(decision), [BUCKET], how)
    else:
        j = df.withColumn(BUCKET, bkt).join(F.broadcast(decision), [*groups, BUCKET], how)
    keep = ((F.col("_state") == "all")
            | ((F.col("_state") == "edge")
               & ((F.col(key) < F.col("_thr_key"))
                  | ((F.col(key) == F.col("_thr_key")) & (F.col(tie) <= F.col("_thr_tie"))))))
    if flag_col:
        j = j.withColumn(flag_col, F.coalesce(keep, F.lit(False)))
    else:
        j = j.where(keep)
    return j.drop(BUCKET, "_state", "_thr_key", "_thr_tie")


def first_n(df: DataFrame, key: str, tie: str, cut: DataFrame | int | float,
            groups: Sequence[str] = (),
            digits: int = 3, flag_col: str | None = None,
            keys: DataFrame | None = None) -> DataFrame:
    """Keep (or flag) the first ``cut`` rows per group in (key, tie) order;
    ``cut`` is a per-group frame or a ratio of each group's size.

    ``keys`` may give a narrow (ids-only) version of ``df`` to plan on;
    by default the needed columns of ``df`` are used, which column pruning
    turns into a narrow scan.
    """
    groups = list(groups)
    k = (keys if keys is not None else df).select(*groups, key, tie)
    decision = cut_decision(k, key, tie, cut, groups, digits)
    return apply_cut(df, key, tie, decision, groups, digits, flag_col)
