"""Token counts through a digest cache.

The cache is a Parquet folder of (tokenizer, content, n_tokens): SHA-256 of
the tokenizer (its file's bytes, library and version) and of the normalised
content (null as empty text; nothing else may change, as a count depends on
every byte). Documents join it by digest, each distinct digest that it lacks is
encoded once, and these counts are appended.

Defined cases: null and empty texts have no tokens; equal texts share a cache
entry; rows may repeat; an empty table gives an empty result. A run that is
repeated after a loss may append an entry again; entries are read distinct.
"""

from __future__ import annotations

import hashlib
import uuid
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm.common import bit_filter, maybe_in, share, text_or_empty
from tetrad.llm.pieces import SPACE, PieceTable, Recent, model_path
from tetrad.session import materialize, scratch_path

LIMIT = 4096
#: digests that occur more than once or are stored are broadcast up to this number;
#: beyond it, bitmaps of them decide most rows, and only the texts of the rest are shuffled
COPIES_BROADCAST_MAX = 300_000
PARTS_KEPT = 300_000
_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    h = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


class _Pieces:
    """Counts by the sentencepiece library. The text is cut where no merge can
    cross (see ``pieces``); parts are counted by the library, each once while
    it is remembered."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_file=path)
        self.split = PieceTable(path).split
        self.known = Recent(PARTS_KEPT)
        self.lead = len(self.sp.encode("\n"))

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        known, out, fresh = self.known, [], {}
        for own in parts:
            for p in own:
                if p not in known.new and p not in fresh:
                    n = known.get(p)
                    if n is None:
                        fresh[p] = 0
        new = list(fresh)
        # the library puts a space mark in front; a line feed keeps it apart from a part without one
        asked = [p[1:].replace(SPACE, " ") if p[0] == SPACE and len(p) > 1 else
                 "\n" + (" " if p == SPACE else p) for p in new]
        for p, ids in zip(new, self.sp.encode(asked, num_threads=1)):
            fresh[p] = len(ids) - (0 if p[0] == SPACE and len(p) > 1 else self.lead)
        get = known.get
        for own in parts:
            out.append(sum([fresh[p] if p in fresh else get(p) for p in own]))
        for p, n in fresh.items():
            known.put(p, n)
        return out


class _Tokenizer:
    """Counts by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.t.encode_batch(texts, add_special_tokens=False)]


_counters: dict[str, object] = {}


def counter(path: str):
    if path not in _counters:
        _counters[path] = _Tokenizer(path) if path.endswith(".json") else _Pieces(path)
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of every text, by the library of the tokenizer file."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        c, out = counter(path), []
        rows = [x or "" for x in texts.to_pylist()]
        for i in range(0, len(rows), 64):
            out += c.count(rows[i:i + 64])
        return pa.array(out, pa.int64())
    return run(text)


def _not_skipped(rows: DataFrame, skip: DataFrame) -> DataFrame:
    return rows.join(skip, "content", "left").filter(
        F.col("stored").isNull() & (F.col("first").isNull() | (F.col("first") == F.col("doc_id"))))


def _by_filters(own: DataFrame, per: DataFrame, stored: DataFrame, skip: DataFrame, n_skip: int) -> tuple[DataFrame, DataFrame]:
    """Rows decided without moving a text: those whose content is surely not in
    ``skip`` are to be encoded (first frame); those that are surely not the
    first row of a content to encode are left out. The others (second frame)
    have to be joined."""
    spark = own.sparkSession
    wanted = materialize(per.join(stored, "content", "left_anti").select(F.xxhash64("content", "first").alias("h")), "count-wanted")
    skipped = share(spark, bit_filter(skip.select(F.xxhash64("content").alias("h")), "h", n_skip))
    firsts = share(spark, bit_filter(wanted, "h", wanted.count()))

    @F.arrow_udf("int")
    def decide(content: pa.Array, row: pa.Array) -> pa.Array:
        in_skip = maybe_in(skipped.value, content.to_numpy())
        return pa.array(np.where(in_skip, np.where(maybe_in(firsts.value, row.to_numpy()), 1, 2), 0).astype(np.int32))
    rows = own.withColumn("decided", decide(F.xxhash64("content"), F.xxhash64("content", "doc_id")))
    return rows.filter("decided = 0"), rows.filter("decided = 1")


def count_tokens(docs: DataFrame, path: str | None = None, cache_path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document.

    ``cache_path`` keeps counts from run to run; without it the cache lives
    in a new folder under the shared checkpoint folder.
    """
    spark, path = docs.sparkSession, path or model_path()
    cache_path = cache_path or scratch_path(spark, f"token-cache-{uuid.uuid4().hex}")
    tokenizer = tokenizer_digest(path)
    spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(cache_path)

    def cache():
        return spark.read.schema(_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == tokenizer) \
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    content = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .withColumn("content", content)
    keys = materialize(own.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")),
                       "count-keys")
    per = keys.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    stored = cache().select("content", F.lit(True).alias("stored"))
    # what not to encode: contents in the cache, and copies other than the first
    skip = materialize(per.join(stored, "content", "left").filter("stored or n > 1")
                       .select("content", "first", "stored"), "count-skip")
    n_skip = skip.count()
    if n_skip <= COPIES_BROADCAST_MAX:
        misses = _not_skipped(own, F.broadcast(skip))
    else:
        clear, open_ = _by_filters(own, per, stored, skip, n_skip)
        misses = clear.select("content", "text").unionByName(_not_skipped(open_, skip).select("content", "text"))
    misses.select(F.lit(tokenizer).alias("tokenizer"), "content", token_count(F.col("text"), path).alias("n_tokens")) \
        .write.mode("append").parquet(cache_path)
    counts = materialize(cache(), "count-found")     # then the join can split a hot content's rows
    return keys.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
