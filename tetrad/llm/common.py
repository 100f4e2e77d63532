"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column as text, mod ``m`` (a null counts as empty text)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % m


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def share(spark: SparkSession, value):
    """A read-only value of bounded size for the Python workers."""
    return spark.sparkContext.broadcast(value)


#: sizes of a filter in bits; the largest takes 128 MB on the driver and in a worker
FILTER_BITS = (1 << 20, 1 << 30)
#: words of a filter that one task packs
PART_WORDS = 1 << 14


def bit_filter(values: DataFrame, column: str, expected: int) -> np.ndarray:
    """Words of a bitmap with a bit for every value of a long column, sixteen
    bits a value within the limits: a value whose bit is clear is not there.
    Bits are joined in Spark; the driver gets the packed parts only."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * max(expected, 1) - 1).bit_length()))

    def pack(t: pa.Table) -> pa.Table:
        own = np.zeros(PART_WORDS, np.int64)
        own[t.column("word").to_numpy() % PART_WORDS] = t.column("w").to_numpy()
        return pa.table({"part": pa.array([t.column("word")[0].as_py() // PART_WORDS]), "w": pa.array([own.tobytes()], pa.binary())})

    at = F.pmod(F.col(column), F.lit(bits))
    words = values.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w"))
    parts = words.groupBy(F.floor(F.col("word") / PART_WORDS).alias("part")).applyInArrow(pack, "part long, w binary").toArrow()
    out = np.zeros(bits // 64, np.int64)
    for part, w in zip(parts.column("part").to_pylist(), parts.column("w").to_pylist()):
        out[part * PART_WORDS:(part + 1) * PART_WORDS] = np.frombuffer(w, np.int64)
    return out.view(np.uint64)


def maybe_in(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a filter of :func:`bit_filter` has the bits of long values."""
    at = values % (len(words) * 64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
