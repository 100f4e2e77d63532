"""Language-model scores by a probabilistic suffix tree.

The tree predicts the bytes of each token (A-Z lower-cased, words parted by
blanks) and its end from variable-length contexts of the text's last bytes, which
may reach into the words before; after the last token it predicts the end of the
text. A context is kept when it
is frequent enough and its next-symbol distribution diverges from that of its
longest proper suffix by a likelihood-ratio test; suffixes of kept contexts are
kept too. Distributions are smoothed by mixing in the suffix's distribution
(Witten-Bell), down to an add-one distribution without context, so the score of
a text is the log10 of a probability. Scoring uses the longest kept suffix.

The tree is a table that grows with the corpus. Each distinct window (a context
and a symbol) of the documents meets the contexts that end like it in one task
and gets its score there; the most frequent windows go to the workers, the
others' occurrences to their hash bucket and back.

The base score needs the training count of every token. Counts are merged in
hash buckets over the whole corpus. Tokens that make up more than
``HEAVY_SHARE`` of the corpus (at most 1 / HEAVY_SHARE of them) go to the
workers; the others' occurrences go to their bucket and come back to their block
of documents as sums, so no task holds one frequent word's occurrences.

Defined cases: a null or empty text is its end alone. Rows may repeat. Without
training rows every count is 0 and the tree is the uniform distribution. An
empty table gives an empty result. A null doc_id counts as the text ''.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import crc_mod, share
from tetrad.session import materialize

FOLDS, HELD_FOLD = 7, 2
#: longest context in bytes
DEPTH = 6
_BITS = 8 * DEPTH
#: contexts up to this depth go to all workers (at most 252 ** SHORT); longer ones stay in a table by their last bytes
SHORT = 2
#: occurrences of a context that is kept
MIN_COUNT = 8
#: nats of likelihood gained per next symbol of a context that is kept
DIVERGENCE = 4.5
HEAVY_SHARE = 2e-6
#: most frequent windows whose scores go to the workers
LIKELY = 1_000_000
#: counts of windows above this are not told apart
MOST_TIMES = 1 << 16
#: documents per hash bucket of the token counts
BUCKET_DOCS = 4096
MAX_BUCKETS = 1 << 16
#: distinct words or windows held by a task before they go out; up to twice as many wait for a merge
FLUSH_WORDS = 2_000_000
#: occurrences of windows that a task counts at once
NEW_WINDOWS = 1 << 21
SLICE = (1 << 19) - 64
#: windows made at once, and occurrences that a task holds before they go to their buckets
PIECE, FLUSH_ASKED = 1 << 18, 1 << 19

# bytes that part words cannot be in one: they stand for the other symbols
STOP, START, END, PAD = 0x20, 0x09, 0x0A, 0x0B
#: 250 bytes, the end of a token, the end of the text
ALPHABET = 252

U = np.uint64
_PAIRS = "kind int, bucket long, keys binary, counts binary"


def _sum_by_key(keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys)                             # sums of whole numbers: equal keys in any order
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _take(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bytes of the spans, one after the other."""
    at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    return data[at]


def _windows(text: np.ndarray, lens: np.ndarray, last: int):
    """For every symbol of the texts (bytes one after the other, and lengths)
    and one ``last`` symbol each: DEPTH context bytes and the symbol as one
    integer, and its text. Yields pieces of at most PIECE symbols."""
    total = lens + DEPTH + 1                              # a start after padding, and the last symbol
    ends = np.cumsum(total)
    x = np.full(int(ends[-1]) if len(ends) else 0, PAD, np.uint8)
    begin = ends - total
    x[begin + DEPTH - 1], x[ends - 1] = START, last
    keep = np.ones(len(x), bool)
    for d in range(DEPTH):
        keep[begin + d] = False
    inner = keep.copy()
    inner[ends - 1] = False
    x[inner] = text
    own = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
    done = 0
    for a in range(DEPTH, len(x), PIECE):
        key = x[a - DEPTH:a + PIECE].astype(U)            # 1, 2, 4, then 7 bytes
        two = key.copy()
        two[1:] |= key[:-1] << U(8)
        key = two.copy()
        key[2:] |= two[:-2] << U(16)
        two = key.copy()
        two[4:] |= (key[:-4] & U(0xFFFFFF)) << U(32)
        key = two[DEPTH:][keep[a:a + PIECE]]
        yield key, own[done:done + len(key)]
        done += len(key)


def windows(text: np.ndarray, lens: np.ndarray):
    """Windows of texts that end in a blank, and the text of each."""
    parts = [*_windows(text, lens, STOP)]
    return (np.concatenate(z) for z in zip(*parts)) if parts else (np.zeros(0, U), np.zeros(0, np.int32))


def document_windows(data, starts, ends, doc, n: int):
    """Windows of ``n`` documents (their tokens, a blank after each, and the end)
    and the document of each, in pieces. Contexts run over the blanks."""
    lens = ends - starts + 1
    text = _take(np.append(data, np.uint8(STOP)), starts, lens)
    text[np.cumsum(lens) - 1] = STOP
    yield from _windows(text, np.bincount(doc, lens, n).astype(np.int64), END)


class _Counts:
    """Distinct keys of a task and their counts."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys, counts):
        self.held.append((keys, counts))
        self.size += len(keys)

    def sums(self):
        return _sum_by_key(*(np.concatenate(x) for x in zip(*self.held)))

    def rows(self, kind: int, buckets: int, last: bool = False):
        """Rows of a partial table, one per bucket, once more than FLUSH_WORDS
        stay after a merge, or at the end. Keys are merged only when as
        many came as may be held, so that each is sorted a few times."""
        if self.size > (0 if last else 2 * FLUSH_WORDS):
            keys, counts = self.sums()
            self.held, self.size = [], 0
            if not last:
                self.add(keys, counts)
                if self.size <= FLUSH_WORDS:
                    return
                self.held, self.size = [], 0
            yield _blobs(kind, keys, counts, buckets)


class _WindowCounts(_Counts):
    """Distinct windows: the seven bytes of a key and a byte of its count are
    one number, so the merge sorts one array. Counts above 255 take several."""

    def __init__(self):
        super().__init__()
        self.new, self.n_new = [], 0

    def see(self, keys):
        """Counts each occurrence of keys."""
        self.new.append(keys)
        self.n_new += len(keys)
        if self.n_new > NEW_WINDOWS:
            self.settle()

    def settle(self):
        if self.n_new:
            keys = np.concatenate(self.new)
            self.new, self.n_new = [], 0
            self.add(*np.unique(keys, return_counts=True))

    def rows(self, kind: int, buckets: int, last: bool = False):
        if last:
            self.settle()
        yield from super().rows(kind, buckets, last)

    def add(self, keys, counts):
        packed = keys << U(8) | (counts % 255).astype(U)
        many = np.flatnonzero(counts >= 255)
        whole = np.repeat(keys[many] << U(8) | U(255), counts[many] // 255)
        self.held += [packed, whole] if len(many) else [packed]
        self.size += len(packed) + len(whole)

    def sums(self):
        packed = np.concatenate(self.held)
        self.held = []
        packed.sort()
        keys = packed >> U(8)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(packed & U(255), first).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(h) % U(buckets)).astype(np.int64)


def _by_bucket(b: np.ndarray) -> np.ndarray:
    """Order by bucket, kept inside one. Numbers below MAX_BUCKETS have 16 bits, which numpy sorts by radix."""
    return np.argsort(b.astype(np.uint16), kind="stable")


def _pack(a: np.ndarray) -> bytes:
    """Compressed bytes, those of the same place in each value together."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, U), dtype=U)


def _blobs(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    b = _bucket(keys, buckets)
    order = _by_bucket(b)
    b, keys, counts = b[order], keys[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
    ends = np.append(at[1:], len(b))
    return pa.record_batch({
        "kind": pa.array(np.full(len(at), kind, np.int32)), "bucket": pa.array(b[at]),
        "keys": pa.array([_pack(np.diff(keys[i:j], prepend=U(0))) for i, j in zip(at, ends)], pa.binary()),
        "counts": pa.array([_pack(counts[i:j]) for i, j in zip(at, ends)], pa.binary())})


def corpus_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Merged counts by bucket: of all words (kind 0) and windows (kind 1) of
    the training rows, and of the windows of the rows ``held`` out (kind 2)."""
    def part(batches):
        counts = [_Counts(), _WindowCounts(), _WindowCounts()]
        for b in batches:
            for held in (False, True):
                own = b.filter(pa.compute.equal(b.column("held"), held))
                for i, j, data, offsets in W.slices(own.column("text"), SLICE):
                    data = W.LOWER[data]
                    starts, ends, doc = W.spans(data, offsets, W.SPACE)
                    if not held:
                        counts[0].add(*np.unique(W.hashes(data, starts, ends), return_counts=True))
                        yield from counts[0].rows(0, buckets)
                    for key, _ in document_windows(data, starts, ends, doc, j - i):
                        counts[1 + held].see(key)
                        yield from counts[1 + held].rows(1 + held, buckets)
        for kind, c in enumerate(counts):
            yield from c.rows(kind, buckets, last=True)

    def merge(t: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_keys(x) for x in t.column("keys").to_pylist()])
        counts = np.concatenate([_unpack(x, np.int64) for x in t.column("counts").to_pylist()])
        keys, counts = _sum_by_key(keys, counts)
        return pa.table({"kind": t.column("kind")[:1], "bucket": t.column("bucket")[:1],
                         "keys": pa.array([_pack(np.diff(keys, prepend=U(0)))], pa.binary()),
                         "counts": pa.array([_pack(counts)], pa.binary()),
                         "types": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    held = F.col("held") if "held" in docs.columns else F.lit(False)
    return docs.select("text", held.alias("held")).mapInArrow(part, _PAIRS).groupBy("kind", "bucket") \
        .applyInArrow(merge, _PAIRS + ", types long, total long")


def _pairs(table: DataFrame, least: float = 0) -> DataFrame:
    """Rows (key, n) of a merged table, those with n >= ``least``."""
    def rows(batches):
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                k, c = _unpack_keys(k), _unpack(c, np.int64)
                ok = c >= least
                yield pa.record_batch({"key": pa.array(k[ok].view(np.int64)), "n": pa.array(c[ok])})
    return table.select("keys", "counts").mapInArrow(rows, "key long, n long")


def context_tree(grams: DataFrame) -> DataFrame:
    """Kept contexts with the counts of their next symbols: ctx (depth above
    its bytes), depth, next, n, total, types. ``grams``: (key, n)."""
    def ctx(k, base):
        return F.lit(k << _BITS).bitwiseOR(base.bitwiseAND(F.lit((1 << 8 * k) - 1)))

    base, forms = F.shiftrightunsigned("key", 8), []
    for k in range(DEPTH + 1):
        oldest = F.shiftrightunsigned(base, 8 * (k - 1)).bitwiseAND(F.lit(255)) if k else F.lit(0)
        forms.append(F.when(oldest != PAD, F.struct(F.lit(k).alias("depth"), ctx(k, base).alias("ctx"))))
    c = grams.select(F.explode(F.array_compact(F.array(*forms))).alias("f"), F.col("key").bitwiseAND(F.lit(255)).alias("next"), "n") \
        .groupBy("f.depth", "f.ctx", "next").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("depth", "ctx")               # a context has as many rows as next symbols
    c = c.withColumn("total", F.sum("n").over(w)).withColumn("types", F.count(F.lit(1)).over(w))
    c = materialize(c.filter(F.col("total") >= MIN_COUNT), "lm-often")
    mask = F.lit((1 << _BITS) - 1)

    def suffix(col, depth):
        """The context one byte shorter."""
        bits = F.pow(F.lit(256.0), depth - 1).cast("long") - 1
        return ((depth - 1) * F.lit(1 << _BITS)).bitwiseOR(col.bitwiseAND(mask).bitwiseAND(bits))

    own = c.filter("depth > 0").withColumn("up", suffix(F.col("ctx"), F.col("depth")))
    up = c.select(F.col("ctx").alias("up"), "next", F.col("n").alias("up_n"), F.col("total").alias("up_total"))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total"))))
    passed = own.join(up, ["up", "next"]).groupBy("depth", "ctx", "types").agg(gain.alias("gain")) \
        .filter(F.col("gain") >= DIVERGENCE * F.col("types"))
    short = [F.when(F.col("depth") >= k, ctx(k, F.col("ctx"))) for k in range(1, DEPTH + 1)]
    kept = passed.select(F.explode(F.array_compact(F.array(*short))).alias("ctx")).distinct()
    return c.join(kept, "ctx", "left_semi").union(c.filter("depth = 0")).select("ctx", "depth", "next", "n", "total", "types")


class SuffixTree:
    """The kept contexts for scoring: probabilities of seen symbols, and what
    is left for others, per context."""

    def __init__(self, t: pa.Table):
        ctx, depth, nxt, n, total, types = (t.column(c).to_numpy().astype(np.int64) for c in
                                            ("ctx", "depth", "next", "n", "total", "types"))
        order = np.lexsort((nxt, ctx))
        ctx, depth, nxt, n, total, types = (a[order] for a in (ctx, depth, nxt, n, total, types))
        self.key = ctx << 8 | nxt
        p = np.zeros(len(ctx))
        for k in range(DEPTH + 1):
            m = depth == k
            if k == 0:
                p[m] = (n[m] + 1) / (total[m] + ALPHABET)
            else:
                up = (k - 1) << _BITS | ctx[m] & ((1 << 8 * (k - 1)) - 1)
                at, _ = W.find(self.key, up << 8 | nxt[m])
                p[m] = (n[m] + types[m] * p[at]) / (total[m] + types[m])
        self.logp = np.log10(p) if len(p) else p
        self.ctx, first = np.unique(ctx, return_index=True)
        self.rest = np.where(depth[first] > 0, np.log10(types[first] / (total[first] + types[first])),
                             -np.log10(total[first] + ALPHABET)) if len(ctx) else np.zeros(0)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each window's symbol after its context."""
        out, open_ = np.zeros(len(key)), np.arange(len(key))
        key = key.astype(np.int64)
        for k in range(DEPTH, -1, -1):
            base, nxt = key[open_] >> 8, key[open_] & 255
            ctx = k << _BITS | base & ((1 << 8 * k) - 1)
            at, seen = W.find(self.key, ctx << 8 | nxt)
            out[open_[seen]] += self.logp[at[seen]]
            open_, ctx = open_[~seen], ctx[~seen]
            at, there = W.find(self.ctx, ctx)
            out[open_[there]] += self.rest[at[there]]
        if not len(self.ctx):
            out -= np.log10(ALPHABET)
        return out


def scored_windows(asked: DataFrame, tree: DataFrame, buckets: int) -> DataFrame:
    """key, n, logp and the key's bucket of the distinct windows ``asked``
    (key, n). All contexts of a window that are longer than SHORT end in the
    same SHORT + 1 bytes; windows and contexts meet by these."""
    mask = (1 << 8 * (SHORT + 1)) - 1
    short = share(tree.sparkSession, tree.filter(F.col("depth") <= SHORT).toArrow())

    def run(asked: pa.Table, tree: pa.Table) -> pa.Table:
        key, n = asked.column("key").to_numpy().view(U), asked.column("n").to_numpy()
        logp = SuffixTree(pa.concat_tables([short.value, tree.select(short.value.column_names)])).score(key) if len(key) else np.zeros(0)
        return pa.table({"key": pa.array(key.view(np.int64)), "n": pa.array(n), "logp": pa.array(logp), "bucket": pa.array(_bucket(key, buckets))})

    def by(column):
        return F.pmod(F.xxhash64(column.bitwiseAND(F.lit(mask))), F.lit(buckets)).alias("part")
    windows = asked.groupBy("key").agg(F.sum("n").alias("n")).select("key", "n", by(F.shiftrightunsigned("key", 8)))
    deep = tree.filter(F.col("depth") > SHORT).select("*", by(F.col("ctx")))
    return windows.groupBy("part").cogroup(deep.groupBy("part")).applyInArrow(run, "key long, n long, logp double, bucket long")


class _Table:
    """Values of keys: a slot each, with its key beside it, in two levels of
    slots; the few keys whose slots are both taken are kept sorted. The last
    keys take the slots, so the most frequent ones should stand there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, h = [], W.mix(keys)
        for wide in (0, 1):
            bits = max(4, (2 * len(keys)).bit_length() + wide)
            slots = np.full((1 << bits, 2), (1 << 64) - 1, U)      # never a key: windows have 7 bytes
            at = h >> U(64 - bits)
            slots[at] = np.stack([keys, values.view(U)], 1)
            left = np.flatnonzero(slots[at, 0] != keys)
            # read as pairs of one item each, so that a look-up touches memory once
            self.levels.append((U(64 - bits), slots.reshape(-1).view(np.complex128)))
            keys, values, h = keys[left], values[left], W.mix(h[left])
        order = np.argsort(keys)
        self.more, self.more_values = keys[order], np.append(values[order], 0.0)

    def find(self, keys: np.ndarray):
        """Values (0 if none) and which keys there are."""
        open_, h = None, W.mix(keys)
        for shift, slots in self.levels:
            pair = np.take(slots, (h >> shift).view(np.int64)).view(U).reshape(-1, 2)
            hit = pair[:, 0] == keys
            miss = np.flatnonzero(~hit)
            if open_ is None:
                out, there, open_ = np.ascontiguousarray(pair[:, 1]).view(np.float64), hit, miss
                out[miss] = 0.0
            else:
                found = open_[hit]
                out[found], there[found], open_ = pair[hit, 1].view(np.float64), True, open_[miss]
            keys, h = keys[miss], W.mix(h[miss])
        at, more = W.find(self.more, keys)
        out[open_[more]], there[open_[more]] = self.more_values[at[more]], True
        return out, there


_OUT = ("block long, kind int, bucket long, doc_id array<long>, held array<boolean>, n_tokens array<long>, "
        "idx array<int>, hash array<long>, base array<double>, known array<long>, score array<double>")


def _lists(arrays, kind) -> pa.Array:
    """Lists over the arrays' values, which are copied as a whole, not one by one."""
    if not arrays:
        return pa.array([], pa.list_(kind))
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    values = pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a, kind) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(offsets).cast(pa.int32()), values)


def _batch(block, kind, bucket, **lists):
    n = len(block)
    kinds = {"doc_id": pa.int64(), "held": pa.bool_(), "n_tokens": pa.int64(), "idx": pa.int32(), "hash": pa.int64(),
             "base": pa.float64(), "known": pa.int64(), "score": pa.float64()}
    cols = {"block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64())}
    for c, kind in kinds.items():
        cols[c] = _lists(lists[c], kind) if c in lists else pa.nulls(n, pa.list_(kind))
    return pa.record_batch(cols)


def _asked(block: int, kind: int, idx: list, keys: list, buckets: int):
    """A row per hash bucket with the occurrences that are looked up there."""
    if not idx:
        return
    idx, keys = np.concatenate(idx), np.concatenate(keys)
    at = _bucket(keys, buckets)
    order = _by_bucket(at)
    at, idx, keys = at[order], idx[order], keys[order].view(np.int64)
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
    if len(cuts):
        ends = np.append(cuts[1:], len(at))
        yield _batch(np.full(len(cuts), block), np.full(len(cuts), kind), at[cuts], idx=[idx[x:y] for x, y in zip(cuts, ends)],
                     hash=[keys[x:y] for x, y in zip(cuts, ends)])


def _map_blocks(docs: DataFrame, heavy, likely, buckets: int, end_count: int) -> DataFrame:
    """A block row per batch of documents (what is known there) and, per hash
    bucket, the occurrences of words (kind 0) and windows (kind 1) whose counts
    and scores are elsewhere."""
    def run(batches):
        from pyspark import TaskContext
        keys, counts = heavy.value
        logs, table = np.log10(counts + 1.0), _Table(*likely.value)
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            block, n = part << 32 | seq, b.num_rows
            n_tokens = np.ones(n, np.int64)
            base = np.full(n, np.log10(end_count + 1.0))
            known = np.full(n, int(end_count > 0), np.int64)
            score = np.zeros(n)
            rare = {0: ([], []), 1: ([], [])}
            for i, j, data, offsets in W.slices(b.column("text"), SLICE):
                data = W.LOWER[data]
                starts, ends, doc = W.spans(data, offsets, W.SPACE)
                h = W.hashes(data, starts, ends)
                m = j - i
                n_tokens[i:j] += np.bincount(doc, minlength=m)
                u, inv = np.unique(h, return_inverse=True)
                at, there = W.find(keys, u)
                base[i:j] += W.per_document(np.where(there, logs[at] if len(logs) else 0.0, 0.0)[inv], doc, m)
                known[i:j] += W.per_document(there[inv], doc, m).astype(np.int64)
                asked = ~there[inv]
                rare[0][0].append((doc[asked] + i).astype(np.int32))
                rare[0][1].append(h[asked])
                for key, own in document_windows(data, starts, ends, doc, m):
                    logp, there = table.find(key)
                    score[i:j] += W.per_document(logp, own, m)
                    rare[1][0].append((own[~there] + i).astype(np.int32))
                    rare[1][1].append(key[~there])
                for kind, (idx, asked) in rare.items():
                    if sum(map(len, idx)) > FLUSH_ASKED:
                        yield from _asked(block, kind, idx, asked, buckets)
                        rare[kind] = ([], [])
            yield _batch([block], [0], [-1], doc_id=[b.column("doc_id")], held=[b.column("held")], n_tokens=[n_tokens],
                         base=[base], known=[known], score=[score])
            for kind, (idx, asked) in rare.items():
                yield from _asked(block, kind, idx, asked, buckets)
    return docs.mapInArrow(run, _OUT)


def _look_up(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """Sums over the asked occurrences of a bucket, for each asking block:
    log counts of words, scores of windows."""
    if asked.num_rows == 0:
        return pa.Table.from_batches([_batch([], [], [])])
    kind = asked.column("kind")[0].as_py()
    keys, values = np.zeros(0, U), np.zeros(0)
    if counts.num_rows:
        keys, values = _unpack_keys(counts.column("keys")[0].as_py()), counts.column("counts")[0].as_py()
        values = _unpack(values, np.float64) if kind else np.log10(_unpack(values, np.int64) + 1.0)
    rows = {"block": [], "idx": [], "sum": [], "known": []}
    for block, idx, h in zip(asked.column("block"), asked.column("idx"), asked.column("hash")):
        idx, h = idx.values.to_numpy(), h.values.to_numpy().view(U)
        at, there = W.find(keys, h)
        if not there.any():
            continue
        u, inv = np.unique(idx[there], return_inverse=True)
        rows["block"].append(block.as_py())
        rows["idx"].append(u)
        rows["sum"].append(np.bincount(inv, values[at[there]]))
        rows["known"].append(np.bincount(inv))
    n = len(rows["block"])
    lists = {"score": rows["sum"]} if kind else {"base": rows["sum"], "known": rows["known"]}
    return pa.Table.from_batches([_batch(rows["block"], [kind] * n, [asked.column("bucket")[0].as_py()] * n, idx=rows["idx"], **lists)])


def _finish(train_tokens: int, denominator: float):
    def run(t: pa.Table) -> pa.Table:
        kind, bucket = (t.column(c).to_pylist() for c in ("kind", "bucket"))
        for i in sorted(range(t.num_rows), key=lambda i: (bucket[i], kind[i], t.column("idx")[i][0].as_py() if bucket[i] >= 0 else 0)):
            if bucket[i] < 0:
                main = i
                base, known, score = (t.column(c)[i].values.to_numpy().copy() for c in ("base", "known", "score"))
                continue
            idx = t.column("idx")[i].values.to_numpy()
            if kind[i]:
                score[idx] += t.column("score")[i].values.to_numpy()
            else:
                base[idx] += t.column("base")[i].values.to_numpy()
                known[idx] += t.column("known")[i].values.to_numpy()
        get = lambda c: t.column(c)[main].values
        n = get("n_tokens").to_numpy()
        return pa.table({"doc_id": get("doc_id"), "held_out": get("held"), "n_tokens": pa.array(n),
                         "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), train_tokens)),
                         "base_score": pa.array(base - n * np.log10(denominator)), "score": pa.array(score)})
    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == HELD_FOLD).alias("held"), "text")
    n_docs = own.count()
    buckets = min(MAX_BUCKETS, max(16, n_docs // BUCKET_DOCS))
    table = materialize(corpus_counts(own, buckets), "lm-counts")
    sums = {r.kind: (r.types or 0, r.total or 0) for r in table.groupBy("kind").agg(
        F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    types, n_words = sums.get(0, (0, 0))
    end_count = own.filter("not held").count()
    train_tokens, types = n_words + end_count, types + (end_count > 0)
    frequent = _pairs(table.filter("kind = 0"), max(2, HEAVY_SHARE * train_tokens)).toArrow()
    keys = frequent.column("key").to_numpy().view(U)
    order = np.argsort(keys)
    heavy = share(spark, (keys[order], frequent.column("n").to_numpy()[order]))
    tree = materialize(context_tree(_pairs(table.filter("kind = 1"))), "lm-tree")
    windows = materialize(scored_windows(_pairs(table.filter("kind > 0")), tree, buckets), "lm-windows")
    sizes = windows.groupBy(F.least("n", F.lit(MOST_TIMES)).alias("n")).agg(F.count(F.lit(1)).alias("k")).toArrow().sort_by([("n", "descending")])
    fit = np.cumsum(sizes.column("k").to_numpy()) <= LIKELY
    often = F.col("n") >= int(sizes.column("n").to_numpy()[fit].min(initial=1 << 62))
    frequent = windows.filter(often).select("key", "logp", "n").toArrow().sort_by([("n", "ascending"), ("key", "ascending")])
    likely = share(spark, (frequent.column("key").to_numpy().view(U), frequent.column("logp").to_numpy()))

    def pack(t: pa.Table) -> pa.Table:
        t = t.set_column(0, "key", pa.array(t.column("key").to_numpy().view(U))).sort_by("key")
        return pa.table({"kind": pa.array([1], pa.int32()), "bucket": t.column("bucket")[:1],
                         "keys": pa.array([_pack(np.diff(t.column("key").to_numpy(), prepend=U(0)))], pa.binary()),
                         "counts": pa.array([_pack(t.column("logp").to_numpy())], pa.binary())})

    blocks = materialize(_map_blocks(own, heavy, likely, buckets, end_count), "lm-blocks")
    rare = windows.filter(~often).select("key", "logp", "bucket").groupBy("bucket").applyInArrow(pack, _PAIRS)
    known = table.filter("kind = 0").select("kind", "bucket", "keys", "counts").unionByName(rare)
    found = known.groupBy("kind", "bucket").cogroup(blocks.filter("bucket >= 0").groupBy("kind", "bucket")) \
        .applyInArrow(_look_up, _OUT)
    return blocks.filter("bucket < 0").unionByName(found).groupBy("block").applyInArrow(
        _finish(train_tokens, float(train_tokens + types + 1)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
