"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter of its texts' 64-bit
fingerprints: the quotient (high bits) names a block, the block keeps its
remainders sorted, each with a count. Filters of all partitions merge block by
block without loss, by merging sorted remainders and adding their counts. Only
fingerprints counted more than once are routed to the byte verification, which
groups the normalised texts themselves.

Defined cases: a null text is an empty text; all empty texts are one group.
Texts are equal when identical after deleting spaces and the characters
0x09-0x0D. Repeated rows are members like any other, and exactly one row of a
group is kept, also if its doc_id occurs several times. A null doc_id comes
after every other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm.common import bit_filter, maybe_in, share, text_or_empty
from tetrad.session import materialize

BLANKS = b" \t\n\x0b\x0c\r"
#: fingerprints expected in a block of the merged filter
BLOCK_SIZE = 4096
#: routed fingerprints are broadcast up to this number (8 bytes each); beyond it, a
#: bitmap of them is, and only texts that it lets pass are shuffled to the join
ROUTE_BROADCAST_MAX = 1_000_000


def _fingerprint_batches(batches):
    for b in batches:
        norm = [(t or b"").translate(None, BLANKS) for t in b.column("text").to_pylist()]
        yield pa.record_batch({
            "doc_id": b.column("doc_id"), "n_chars": b.column("n_chars"),
            "fp": pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in norm], pa.int64()),
            "sha": pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary())})


def _normalised_batches(batches, routed=None):
    """Fingerprints and normalised texts, of those that a filter lets pass."""
    for b in batches:
        norm = [(t or b"").translate(None, BLANKS) for t in b.column("text").to_pylist()]
        out = pa.record_batch({
            "fp": pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in norm], pa.int64()),
            "norm": pa.array(norm, pa.binary())})
        yield out if routed is None else out.filter(pa.array(maybe_in(routed.value, out.column("fp").to_numpy())))


def _filter_rows(fps: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (block, remainders, counts) of a quotient filter; ``fps`` sorted."""
    block = (fps >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fps), np.int64)
    rest = (fps & np.uint64((1 << (64 - bits)) - 1)).astype(np.uint64)
    blocks, at = np.unique(block, return_index=True)
    ends = np.append(at[1:], len(fps))
    return pa.record_batch({
        "block": pa.array(blocks, pa.int64()),
        "remainders": pa.array([rest[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
        "counts": pa.array([counts[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())})


def _merge(keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def quotient_filter(fingerprints: DataFrame, bits: int) -> DataFrame:
    """Counting quotient filter of the long column ``fp``: one per partition,
    then merged. Returns (fp, n) of every stored fingerprint with n > 1."""
    def build(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            new = (b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64) ^ np.uint64(1 << 63)
            keys, counts = _merge(np.append(keys, new), np.append(counts, np.ones(len(new), np.int64)))
            if len(keys) >= 1 << 20:            # a full filter goes out, a new one begins
                yield _filter_rows(keys, counts, bits)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _filter_rows(keys, counts, bits)

    def merge(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rest = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("remainders").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        rest, counts = _merge(rest, counts)
        many = counts > 1
        fps = (rest[many] | np.uint64(block << (64 - bits))) ^ np.uint64(1 << 63)
        return pa.table({"fp": pa.array(fps.view(np.int64)), "n": pa.array(counts[many])})

    blocks = fingerprints.select("fp").mapInArrow(build, "block long, remainders binary, counts binary")
    return blocks.groupBy("block").applyInArrow(merge, "fp long, n long")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = own.select("doc_id", F.length("text").alias("n_chars"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(_fingerprint_batches, "doc_id long, n_chars int, fp long, sha binary")
    keys = materialize(keys.withColumn("row", F.monotonically_increasing_id()), "exact-keys")
    bits = max(0, int(keys.count() // BLOCK_SIZE).bit_length())
    routed = materialize(quotient_filter(keys, bits).select("fp"), "exact-routed")
    n_routed = routed.count()
    few = n_routed <= ROUTE_BROADCAST_MAX
    side = F.broadcast(routed) if few else routed
    passing = None if few else share(spark, bit_filter(routed, "fp", n_routed))

    # byte verification: the grouping key is the text; copies meet as one row of each task
    texts = own.select(F.col("text").cast("binary").alias("text")) \
        .mapInArrow(lambda it: _normalised_batches(it, passing), "fp long, norm binary").join(side, "fp", "left_semi")
    classes = texts.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("n")) \
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n") \
        .groupBy("fp", "sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts"))
    best = keys.join(side, "fp", "left_semi").groupBy("fp", "sha").agg(
        F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg"),
                       (-F.col("row")).alias("neg_row"))).alias("b"))
    groups = classes.join(best, ["fp", "sha"]).select(
        "fp", "sha", "n", (-F.col("b.neg")).alias("keep_id"),
        F.when(F.col("n_texts") == 1, -F.col("b.neg_row"))
        .otherwise(F.raise_error(F.lit("different texts share a SHA-256"))).alias("keep_row"))
    groups = materialize(groups, "exact-groups")     # then the join below can split a hot group's rows
    alone = F.col("n").isNull()
    return keys.join(groups, ["fp", "sha"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The dropped (doc_id, text) pairs go by an anti join; where a kept pair is
    itself repeated, one of its rows stays.
    """
    out = materialize(duplicate_groups(docs), "exact-rows")
    key = ["_k_id", "_k_sha"]
    ids = out.select(F.col("doc_id").alias(key[0]), F.col("text_sha256").alias(key[1]), "kept", "group_size")
    per = ids.filter("group_size > 1").groupBy(*key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    per = materialize(per.filter("not kept or n > 1"), "exact-per-key")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias(key[0]),
                       F.sha2(F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", ""), 256).alias(key[1]),
                       F.length(text_or_empty()).alias("_k_len"))
    match = rows[key[0]].eqNullSafe(per[key[0]]) & (rows[key[1]] == per[key[1]])
    once = rows.join(per, match, "left_anti").select("row.*")
    repeated = per.filter("kept")
    if repeated.isEmpty():
        return once
    w = Window.partitionBy(*key).orderBy(F.desc("_k_len"), F.xxhash64("row"))
    again = rows.join(repeated, match, "left_semi").withColumn("_k_rank", F.row_number().over(w))
    return once.unionByName(again.filter("_k_rank = 1").select("row.*"))
