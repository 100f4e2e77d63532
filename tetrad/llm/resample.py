"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are all its runs of one to three words. A feature's bucket is
the CRC-32 of its bytes modulo ``BUCKETS``. The CRC is never taken of a whole
feature: an Aho-Corasick dictionary of delimiter-bounded distinct words carries
each word's CRC and length as payload, a scan of the text emits the payloads in
order, and those of adjacent words are composed (the CRC of a concatenation is
linear in the CRC of its first part). Words that a task's dictionary has not
taken up (it is bounded) get their payload computed where they stand, so the
result does not depend on the dictionary's size.

Counts of the buckets over all documents (S, s) and over the target's texts
(T, t) give each bucket's gain; a document's weight is the sum of the gains of
its features, and Gumbel noise from a digest of its id makes the highest scores
a draw without replacement.

Only numbers are shuffled: at most ``BUCKETS`` counts a task, then ids and
scores, ordered by range. Counts and gains, of fixed size, pass the driver.

Defined cases: a null or empty text has no features and weight 0. A null doc_id
counts as the text '' in the noise and comes after other ids among equal
scores. Repeated rows are separate documents. Without a target every gain is
that of t = T = 0. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import share
from tetrad.session import materialize
from tetrad.sources.tables import spread

BUCKETS = 10_000
LONGEST = 3
#: share of the documents that is drawn, in percent, and the fewest words of one that may be
PERCENT, LEAST_WORDS = 5, 20
SEED = "42"
#: words that a task's dictionary takes up, and bytes of a word that it takes
KEPT, KEPT_BYTES = 50_000, 64
#: new words after which the automaton is made again (else as many as it holds)
FRESH = 4_096

_BITS = np.uint32(0xEDB88320)          # the polynomial of CRC-32, lowest power first


def _one_byte() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), _BITS, np.uint32(0))
    return c


class Shift:
    """The CRC of a text after ``n`` zero bytes, as a linear map of its 32 bits:
    a table per byte of the CRC for each n below 256, and for 256 times every
    power of two."""

    def __init__(self):
        step = _one_byte()
        place = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None])
        self.short = np.empty((256, 4, 256), np.uint32)
        for n in range(256):
            self.short[n] = place
            place = (place >> np.uint32(8)) ^ step[place & np.uint32(255)]
        self.long = [place]                               # by 256 bytes, 512, ...
        while len(self.long) < 32:
            self.long.append(self._apply(self.long[-1], self.long[-1]))

    @staticmethod
    def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]

    def __call__(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        low, flat = (n & 255) << 10, self.short.reshape(-1)
        out = np.zeros(len(c), np.uint32)
        for j in range(4):
            out ^= flat[low + (j << 8) + ((c >> np.uint32(8 * j)) & np.uint32(255))]
        high, k = n >> 8, 0
        while high.any():
            at = np.flatnonzero(high & 1)
            out[at] = self._apply(self.long[k], out[at])
            high, k = high >> 1, k + 1
        return out


class Dictionary:
    """Words with their payloads: the CRC of the word, the CRC of the delimiter
    and the word, and the word's length."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.number = kept, {}
        self.payload = np.zeros((3, 0), np.int64)
        self.automaton, self.fresh, self.step = None, [], _one_byte()

    def _grow(self) -> None:
        """Takes the fresh words into the automaton."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
        new = [(zlib.crc32(w), zlib.crc32(b" " + w), len(w)) for w in self.fresh]
        for w in self.fresh:
            self.automaton.add_word(f" {w.decode('latin-1')} ", self.number[w])
        self.payload = np.hstack([self.payload, np.array(new, np.int64).T])
        self.automaton.make_automaton()
        self.fresh = []

    def _direct(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Both CRCs of words where they stand, byte by byte for all words at once; of long words by the library."""
        word, after = (np.full(len(starts), x, np.uint32) for x in (0xFFFFFFFF, zlib.crc32(b" ") ^ 0xFFFFFFFF))
        long = ends - starts > KEPT_BYTES
        at = np.flatnonzero(~long)
        for k in range(KEPT_BYTES):
            at = at[ends[at] - starts[at] > k]
            if not len(at):
                break
            byte = low[starts[at] + k]
            for c in (word, after):
                c[at] = (c[at] >> np.uint32(8)) ^ self.step[(c[at] ^ byte) & np.uint32(255)]
        word, after = ~word, ~after
        for i in np.flatnonzero(long).tolist():
            w = low[starts[i]:ends[i]].tobytes()
            word[i], after[i] = zlib.crc32(w), zlib.crc32(w, zlib.crc32(b" "))
        return word, after

    def payloads(self, low: np.ndarray, offsets: np.ndarray, starts, ends, doc) -> np.ndarray:
        """Payload of every word of the lower-cased texts, in order."""
        out = np.zeros((3, len(starts)), np.int64)
        known = np.zeros(len(starts), bool)
        if self.automaton is not None:
            text = np.where(W.NON_ALNUM[low], np.uint8(0x20), low)
            text = np.insert(text, offsets, 0x20)         # a delimiter before every text and after the last
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.tobytes().decode("latin-1"))), np.int64)
            at = np.searchsorted(ends + doc + 1, hits[::2])
            out[:, at], known[at] = self.payload[:, hits[1::2]], True
        rest = np.flatnonzero(~known)
        out[0, rest], out[1, rest], out[2, rest] = *self._direct(low, starts[rest], ends[rest]), ends[rest] - starts[rest]
        if len(self.number) < self.kept:
            raw = low.tobytes()
            for i in rest.tolist():
                w = raw[starts[i]:ends[i]]
                if len(self.number) < self.kept and len(w) <= KEPT_BYTES and w not in self.number:
                    self.number[w] = len(self.number)
                    self.fresh.append(w)
        if len(self.fresh) >= max(FRESH, self.payload.shape[1]) or (self.fresh and len(self.number) == self.kept):
            self._grow()
        return out


class Features:
    """Buckets of all features of texts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST, kept: int = KEPT):
        self.buckets, self.longest = buckets, longest
        self.shift, self.words = Shift(), Dictionary(kept)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Bucket and text of every feature, and the words of each text."""
        low = W.LOWER[data]
        starts, ends, doc = W.spans(low, offsets, W.NON_ALNUM)
        count = np.bincount(doc, minlength=len(offsets) - 1)
        if not len(starts):
            return np.zeros(0, np.int64), doc, count
        alone, after, size = self.words.payloads(low, offsets, starts, ends, doc)
        run = alone.astype(np.uint32)
        found, where = [run], [doc]
        for k in range(1, self.longest):                  # runs that end at word i: the run to the word before, shifted
            run = self.shift(run[:-1], size[k:] + 1) ^ after[k:].astype(np.uint32)
            inside = doc[k:] == doc[:-k]
            found.append(run[inside])
            where.append(doc[k:][inside])
        return np.concatenate(found).astype(np.int64) % self.buckets, np.concatenate(where), count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts (column ``text``) by bucket."""
    def run(batches):
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in W.slices(b.column("text")):
                total += np.bincount(features(data, offsets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Rows of ``docs`` (its columns but ``text``) with n_words, n_features and weight."""
    held, rest = share(docs.sparkSession, gain), [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches):
        gain = held.value
        features = Features(len(gain), longest)
        for b in batches:
            out = [np.zeros((3, 0), np.int64)]
            for i, j, data, offsets in W.slices(b.column("text")):
                bucket, doc, count = features(data, offsets)
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, doc, gain[bucket])
                n = sum(np.maximum(count - k, 0) for k in range(longest))
                out.append(np.stack([count, n, weight]))
            n_words, n, weight = np.hstack(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n_words), pa.array(n), pa.array(weight)],
                                             [*rest, "n_words", "n_features", "weight"])
    return docs.select(*rest, "text").mapInArrow(run, f"{fields}, n_words long, n_features long, weight long")


def noise(doc_id, seed: str = SEED):
    """Gumbel noise in whole thousandths, from a digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def in_order(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their ``rank`` in ``order`` (from 1), which must leave no ties.

    Rows are dealt by range and written; a part's ranks start after the rows of
    the parts before it. One count a part passes the driver."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(starts), "part") \
        .withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def importance_scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``, and
    ``rank`` of those drawn (else null)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    gain = gains(bucket_counts(spread(own)), bucket_counts(target))
    scored = materialize(weigh(spread(own), gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
                         .withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    may = scored.filter(F.col("n_words") >= least_words)
    most = may.count() * percent // 100
    ranked = in_order(may, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest).drop("row")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of ``docs``, all columns, by unique doc_id."""
    drawn = importance_scores(docs, target, percent, least_words).filter("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return importance_scores(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
