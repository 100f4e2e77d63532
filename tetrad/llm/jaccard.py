"""Jaccard join on word n-grams by a universe partition and the pigeonhole.

Two sets of sizes l1 <= l2 reach the similarity only if l1 >= t * l2 and at most
H elements differ. Sets are put into size bands of ratio 1 / t; a set takes part
in the scheme of its own band and of the band below. A scheme hashes the
elements into 2 * (H // 2 + 1) segments and pairs them up; as fewer than two
elements per pair can differ on average, some pair of segments differs by one
element at most. So one of its two segments is equal, and the other is equal or
one of its one-element deletions is.

Each segment of a set is indexed under its content (a key). What this costs is
measured first: key counts over the corpus, in hashed cells. A key that few sets
have is emitted as it is; a frequent one is replaced by the narrower keys
(segment, partner) and (segment, partner less one element). The choice depends on
the key alone, so both sets of a link make the same one, and no link is lost.

Sets with a common key are candidates. Each class is first compared with the
centre that it shares most groups with, a few times; then, in tiles of bounded
size, all pairs of a group that are not yet in one component, if their sizes and the parity bitmaps of their sets
(whose distance never exceeds the true one) allow a link. Links are verified
exactly, on the sets of 64-bit shingle hashes. Equal sets are one class from the start.

Defined cases: null and empty texts, and texts without words, have an empty set
and no link. With fewer words than a shingle the whole sequence is the one
shingle. Rows may repeat; they are equal sets. A null doc_id is never the
smallest id of a component that has another. An empty table gives an empty
result. The distinct sets that share one key meet in one task, at 17 bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import share
from tetrad.llm.components import components
from tetrad.session import materialize

U = np.uint64
#: a key that fewer sets share is emitted as it is
FREQUENT = 8
#: cells of the key counts: as many as half the keys, within these limits
CELLS = (1 << 16, 1 << 30)
BITMAP = 1024
#: members of a group, and of the groups of a family, that one task compares
BLOCK = 4096
FAMILY_MEMBERS = 1 << 20
#: times that each class is compared with a centre before all open pairs are
CENTRE_ROUNDS = 3
#: bits of the filter of classes whose sets are fetched
FETCH_BITS = 1 << 27
#: keys per bucket that a task groups
BUCKET_KEYS = 1 << 20
MAX_BUCKETS = 1 << 16
SLICE = (1 << 20) - 64


class Rule:
    """Similarity at least ``num`` / ``den``, shingles of ``n`` words."""

    def __init__(self, n: int = 4, num: int = 85, den: int = 100):
        self.n, self.num, self.den = n, num, den

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)

    def differing(self, a, b):
        """Most elements that two linked sets of these sizes can differ by."""
        return ((a + b) * (self.den - self.num)) // (self.den + self.num)

    def band(self, size: np.ndarray) -> np.ndarray:
        """Band of each size; linked sizes are in the same or in adjacent bands."""
        return np.searchsorted(self.tops(int(size.max()) if len(size) else 1), size)

    def tops(self, largest: int) -> np.ndarray:
        """Largest size of every band."""
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, (tops[-1] + 1) * self.den // self.num))
        return np.array(tops)

    def pairs(self, top: int) -> int:
        """Pairs of segments in the scheme of the band up to ``top``; none if
        only equal sets can be linked."""
        h = int(self.differing(top, top * self.den // self.num))
        return h // 2 + 1 if h else 0


def shingles(data: np.ndarray, offsets: np.ndarray, n: int):
    """Hash and document of every shingle (not yet distinct)."""
    starts, ends, doc = W.spans(W.LOWER[data], offsets, W.SPACE)
    h = W.hashes(W.LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    out, at = h.copy(), np.arange(len(h))
    first = np.cumsum(count) - count
    size = np.minimum(count, n)[doc] if len(doc) else count[:0]      # words of this document's shingles
    for k in range(1, n):
        nxt = np.minimum(at + k, max(0, len(h) - 1))
        out = np.where(k < size, W.mix(out * U(0x9E3779B97F4A7C15) + h[nxt]), out)
    out = W.mix(out + size.astype(U))
    keep = at - first[doc] <= count[doc] - size if len(doc) else np.zeros(0, bool)
    return out[keep], doc[keep]


def sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """Distinct shingles in order of document, and where each document's begin."""
    s, doc = shingles(data, offsets, n)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, doc, np.append(0, np.cumsum(np.bincount(doc, minlength=len(offsets) - 1)))


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs that begin at ``at`` (one past the end last)."""
    total = np.append(U(0), np.cumsum(values, dtype=U))
    return total[at[1:]] - total[at[:-1]]


def identity(s: np.ndarray, at: np.ndarray):
    """128-bit fingerprint of each set, independent of order."""
    return W.mix(_sum(W.mix(s), at) + U(1)), W.mix(_sum(W.mix(s ^ U(0x5851F42D4C957F2D)), at) + U(2))


def _bitmaps(s: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    bits = np.bincount(doc * BITMAP + (s % U(BITMAP)).astype(np.int64), minlength=n * BITMAP) & 1
    return np.packbits(bits.reshape(n, BITMAP).astype(bool), axis=1)


def _known(batches, rule: Rule):
    """Classes: a row per document with its set's identity, size and bitmap."""
    for b in batches:
        for i, j, data, offsets in W.slices(b.column("text"), SLICE // 4):
            s, doc, at = sets(data, offsets, rule.n)
            a, c = identity(s, at)
            for x in range(0, j - i, 1024):
                y = min(j - i, x + 1024)
                own = slice(at[x], at[y])
                bits = _bitmaps(s[own], doc[own] - x, y - x)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(i + x, y - x), "text_hash": b.column("text_hash").slice(i + x, y - x),
                    "class": pa.array(a[x:y].view(np.int64)),
                    "other": pa.array(c[x:y].view(np.int64)), "size": pa.array(np.diff(at[x:y + 1]).astype(np.int64)),
                    "bits": pa.array([r.tobytes() for r in bits], pa.binary())})


class _Seen:
    """Which sets of a task are new: each class is taken once."""

    def __init__(self):
        self.old, self.fresh = np.zeros(0, U), []

    def new(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(self.fresh) > 64:
            self.old, self.fresh = np.unique(np.concatenate([self.old, *self.fresh])), []
        new = ~W.find(self.old, a)[1] & (np.diff(at) > 0)
        for f in self.fresh:
            new &= ~np.isin(a, f)
        _, once = np.unique(a, return_index=True)
        first = np.zeros(len(a), bool)
        first[once] = True
        new &= first
        self.fresh.append(a[new])
        return new


def _first_seen(batches, rule: Rule):
    """(sets, documents, begins, classes, which are new) of a task's slices."""
    seen = _Seen()
    for b in batches:
        for _, _, data, offsets in W.slices(b.column("text"), SLICE):
            s, doc, at = sets(data, offsets, rule.n)
            a, _ = identity(s, at)
            yield s, doc, at, a, seen.new(a, at)


def _texts_seen(batches, rule: Rule):
    """(lower-cased bytes, offsets, classes, which are new) of a task's slices."""
    seen = _Seen()
    for b in batches:
        for _, _, data, offsets in W.slices(b.column("text"), SLICE):
            s, _, at = sets(data, offsets, rule.n)
            a, _ = identity(s, at)
            yield W.LOWER[data], offsets, a, seen.new(a, at)


def segment_keys(s, doc, at, rule: Rule, rows: np.ndarray):
    """Segments of the given documents in both of their schemes.

    Yields per scheme side (own band, band below): the elements' order by
    segment, the segment each belongs to, and per segment: document, key, and
    whether the scheme is its own band's.
    """
    size = np.diff(at)
    tops = rule.tops(int(size.max()) if len(size) else 1)
    band = np.searchsorted(tops, size)
    pairs = np.array([rule.pairs(int(t)) for t in tops])
    for below in (0, 1):
        scheme = band - below
        use = rows & (scheme >= 0)
        use &= pairs[np.maximum(scheme, 0)] > 0
        if below:                               # only sizes that a set of the band below can reach
            use &= rule.num * size <= rule.den * tops[np.maximum(scheme, 0)]
        docs = np.flatnonzero(use)
        if not len(docs):
            continue
        m = 2 * pairs[scheme[docs]]             # segments of each document
        base = np.cumsum(m) - m
        where = np.full(len(size), -1)
        where[docs] = np.arange(len(docs))
        e = np.flatnonzero(use[doc])
        d = where[doc[e]]
        h = W.mix(s[e] + U(0x632BE59BD9B4E019) * (scheme[docs][d] + 1).astype(U))
        seg = base[d] + ((h >> U(11)) % m[d].astype(U)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        total = int(m.sum())
        count = np.bincount(seg, minlength=total)
        begin = np.append(0, np.cumsum(count))
        elements = W.mix(s[e][order] ^ U(0xD6E8FEB86659FD93))
        content = _sum(elements, begin)
        owner = np.repeat(np.arange(len(docs)), m)
        number = np.arange(total) - base[owner]
        tag = W.mix((scheme[docs][owner] + 1).astype(U) << U(32) | number.astype(U))
        yield docs[owner], content, tag, begin, elements, below == 0


def _keys(content, tag):
    return W.mix(content + tag * U(3))


def _cells(key: np.ndarray, cells: int) -> np.ndarray:
    return (W.mix(key ^ U(0xA0761D6478BD642F)) & U(cells - 1)).astype(np.int64)


def _blob_rows(bucket: np.ndarray, buckets: int, **columns):
    """One row per bucket with the bytes of its part of the columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    end = np.append(cut[1:], len(bucket))
    out = {"bucket": pa.array(bucket[cut].astype(np.int64))}
    for name, c in columns.items():
        c = c[order]
        out[name] = pa.array([c[i:j].tobytes() for i, j in zip(cut, end)], pa.binary())
    return pa.record_batch(out)


def frequent_cells(docs: DataFrame, rule: Rule, cells: int, expected: int) -> np.ndarray:
    """Bitmap of the cells whose keys are frequent: FREQUENT sets, or four times
    a cell's mean if that is more. Each bucket returns its part as packed bits."""
    buckets = int(min(MAX_BUCKETS, max(16, cells >> 20)))
    width = max(1, cells // buckets)

    def count(batches):
        held, n = [], 0

        def flush():
            c, k = np.unique(np.concatenate(held), return_counts=True)
            return _blob_rows(c // width, buckets, cell=(c % width).astype(np.uint32), n=np.minimum(k, 65535).astype(np.uint16))
        for s, doc, at, _, new in _first_seen(batches, rule):
            for _, content, tag, _, _, _ in segment_keys(s, doc, at, rule, new):
                held.append(_cells(_keys(content, tag), cells))
                n += len(held[-1])
            if n > 4 << 20:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    least = max(FREQUENT, 4 * expected // cells)

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c, k in zip(t.column("cell").to_pylist(), t.column("n").to_pylist()):
            total += np.bincount(np.frombuffer(c, np.uint32), np.frombuffer(k, np.uint16), width).astype(np.int64)
        hot = np.packbits(total >= least, bitorder="little")
        return pa.table({"bucket": t.column("bucket")[:1], "bits": pa.array([hot.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "bucket long, cell binary, n binary").groupBy("bucket") \
        .applyInArrow(merge, "bucket long, bits binary").toArrow()
    bits = np.zeros(buckets * width // 8, np.uint8)
    for bucket, part in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        bits[bucket * width // 8:(bucket + 1) * width // 8] = np.frombuffer(part, np.uint8)
    return bits


def index_keys(s, doc, at, rule: Rule, new, bits: np.ndarray):
    """Keys under which the given documents are indexed: (key, document, own)."""
    cells = len(bits) * 8
    for owner, content, tag, begin, elements, own in segment_keys(s, doc, at, rule, new):
        key = _keys(content, tag)
        cell = _cells(key, cells)
        hot = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        yield key[~hot], owner[~hot], own
        seg = np.flatnonzero(hot)               # with the partner's content, whole and less one element
        if not len(seg):
            continue
        partner = seg ^ 1                       # a document's segments begin at an even number
        whole = content[partner]
        n = (begin[1:] - begin[:-1])[partner]
        each = np.repeat(np.arange(len(seg)), n)
        element = np.repeat(begin[partner] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield W.mix(key[seg] ^ W.mix(whole + U(7))), owner[seg], own
        yield W.mix(key[seg][each] ^ W.mix(whole[each] - elements[element] + U(7))), owner[seg][each], own


def candidate_groups(docs: DataFrame, rule: Rule, bits, buckets: int) -> DataFrame:
    """Distinct groups of classes that share a key: (members: array<long>)."""
    def index(batches):
        held, n = [], 0

        def flush():
            key, cls, own = (np.concatenate(x) for x in zip(*held))
            return _blob_rows((key % U(buckets)).astype(np.int64), buckets, key=key, cls=cls, own=own)
        for s, doc, at, a, new in _first_seen(batches, rule):
            for key, owner, own in index_keys(s, doc, at, rule, new, bits.value):
                held.append((key, a[owner], np.full(len(key), own)))
                n += len(key)
            if n > 2 << 20:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def group(t: pa.Table) -> pa.Table:
        key, cls, own = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
                         for c, kind in (("key", U), ("cls", np.int64), ("own", bool)))
        order = np.lexsort((cls, key))
        key, cls, own = key[order], cls[order], own[order]
        same = np.append(False, (key[1:] == key[:-1]) & (cls[1:] == cls[:-1]))
        head = np.flatnonzero(~same)
        own = np.logical_or.reduceat(own, head) if len(head) else own
        key, cls = key[head], cls[head]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        n = np.diff(np.append(cut, len(key)))
        any_own = np.logical_or.reduceat(own, cut) if len(cut) else own
        ok = (n > 1) & any_own
        groups = {cls[i:i + k].tobytes() for i, k in zip(cut[ok].tolist(), n[ok].tolist())}
        return pa.table({"members": pa.array([np.frombuffer(g, np.int64) for g in sorted(groups)], pa.list_(pa.int64()))})

    return docs.select("text").mapInArrow(index, "bucket long, key binary, cls binary, own binary") \
        .groupBy("bucket").applyInArrow(group, "members array<long>").distinct()


def _allowed(a_size, b_size, a_bits, b_bits, rule: Rule) -> np.ndarray:
    """Whether sizes and bitmaps (rows of bytes) allow a link."""
    ok = rule.den * np.minimum(a_size, b_size) >= rule.num * np.maximum(a_size, b_size)
    return ok & (np.bitwise_count(a_bits ^ b_bits).sum(1, dtype=np.int64) <= rule.differing(a_size, b_size))


def _cross_pairs(batches, rule: Rule):
    """Pairs of a tile's members that are in different components and that
    sizes and bitmaps allow; where two blocks meet, of different blocks only."""
    for batch in batches:
        g = batch.column("g")
        cuts, flat = g.offsets.to_numpy(), g.flatten()
        node, root, size, block = (flat.field(c).to_numpy() for c in ("c", "root", "size", "block"))
        two = batch.column("two").to_pylist()
        bits = np.frombuffer(b"".join(flat.field("bits").to_pylist()), np.uint8).reshape(-1, BITMAP // 8)
        cuts = cuts - cuts[0]
        found, n = [], 0

        def flush():
            u, v = (np.concatenate(z) for z in zip(*found))
            pair = np.unique(np.stack([u, v]), axis=1)
            return pa.record_batch({"a": pa.array(pair[0]), "b": pa.array(pair[1])})
        for x, y, cross in zip(cuts[:-1].tolist(), cuts[1:].tolist(), two):
            for i in range(x, y - 1):
                apart = root[i + 1:y] != root[i]
                j = i + 1 + np.flatnonzero(apart & (block[i + 1:y] != block[i]) if cross else apart)
                if not len(j):
                    continue
                j = j[_allowed(size[i], size[j], bits[i], bits[j], rule)]
                found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                n += len(j)
            if n > 1 << 19:
                yield flush()
                found, n = [], 0
        if found:
            yield flush()


def open_groups(groups: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (id, c, root) of the groups that are not in one component yet."""
    member = groups.withColumn("id", F.xxhash64("members")).select("id", F.explode("members").alias("c"))
    if roots is None:
        return member.withColumn("root", F.col("c"))
    member = member.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    split = member.groupBy("id").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("id")
    return member.join(split, "id", "left_semi")


def open_pairs(member: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Possible pairs (a, b) of members of open groups. A group is cut into
    blocks of about BLOCK members by hash; each two blocks (and each block with
    itself) are a tile, compared for itself, so no row holds a whole group."""
    group = member.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("family")) \
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # groups of one family have many pairs in common: they meet in a task by their smallest root, which
    # returns a pair once; a large family is dealt to several tasks
    family = group.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY_MEMBERS).cast("int").alias("parts"))
    group = group.join(family, "family").select("id", "blocks", "family", F.pmod("id", "parts").alias("part"))
    member = member.join(group, "id").join(classes.select(F.col("class").alias("c"), "size", "bits"), "c") \
        .withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = member.groupBy("id", "family", "part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")) \
        .agg(F.collect_list(F.struct("c", "root", "size", "bits", "block")).alias("g"))
    place = ["family", "part", "lo", "hi"]
    return tile.repartition(*place).sortWithinPartitions(*place).select("g", (F.col("lo") != F.col("hi")).alias("two")) \
        .mapInArrow(lambda it: _cross_pairs(it, rule), "a long, b long").distinct()


def best_pairs(member: DataFrame) -> DataFrame:
    """One pair (a, b) at most for every class of the groups (id, c, root): with
    the centre that it shares most groups with, if that is in another
    component. A group's centre is its member that is in most groups: the text
    that the others were made from keeps more segments in common with them than
    they do with each other."""
    degree = member.groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    centre = member.join(degree, "c").groupBy("id").agg(F.max(F.struct("d", (-F.col("c")).alias("neg"), "root")).alias("m")) \
        .select("id", (-F.col("m.neg")).alias("a"), F.col("m.root").alias("a_root"))
    stars = member.join(centre, "id").filter("root != a_root").groupBy("a", F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("neg"))).alias("x")).select((-F.col("x.neg")).alias("a"), "b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def words_of(wanted: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(c, s): the compressed words of each wanted class (c). A bitmap of the
    wanted classes goes to the workers."""
    spark = docs.sparkSession
    need = wanted.select(F.pmod("c", F.lit(FETCH_BITS)).alias("bit")).distinct() \
        .groupBy(F.shiftright("bit", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).toArrow()
    bits = np.zeros(FETCH_BITS // 64, np.int64)
    bits[need.column("word").to_numpy()] = need.column("w").to_numpy()
    bits = share(spark, bits.view(U))

    def fetch(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for data, offsets, a, new in _texts_seen(batches, rule):
            bit = (a.view(np.int64) % FETCH_BITS).astype(U)
            rows = np.flatnonzero(new & ((bits.value[(bit >> U(6)).astype(np.int64)] >> (bit & U(63)) & U(1)) == 1))
            for x in range(0, len(rows), 256):
                own = rows[x:x + 256]
                yield pa.record_batch({"c": pa.array(a[own].view(np.int64)),
                                       "s": pa.array([pack(b" ".join(data[offsets[r]:offsets[r + 1]].tobytes().split()))
                                                      for r in own], pa.binary())})
    return docs.select("text").mapInArrow(fetch, "c long, s binary").groupBy("c").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, words: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes that are linked, by their whole sets, built again
    from the classes' words."""
    def check(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        kept: dict[int, np.ndarray] = {}

        def of(c, words):
            if c not in kept:
                if len(kept) >= 512:
                    kept.clear()
                text = np.frombuffer(unpack(words), np.uint8)
                kept[c] = sets(text, np.array([0, len(text)]), rule.n)[0]
            return kept[c]
        for p in batches:
            ok = []
            for a, b, x, y in zip(*(p.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = of(a, x), of(b, y)
                both = np.concatenate([x, y])
                both.sort()
                ok.append(rule.linked(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            yield pa.record_batch({c: p.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    return pairs.join(words.select(F.col("c").alias("b"), F.col("s").alias("y")), "b") \
        .join(words.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").mapInArrow(check, "a long, b long")


def join_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    return _joined(docs, rule or Rule()).drop("text_hash")


def _joined(docs: DataFrame, rule: Rule) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        lambda it: _known(it, rule), "doc_id long, text_hash long, class long, other long, size long, bits binary")
    known = materialize(known, "jaccard-known")
    classes = materialize(known.filter("size > 0").groupBy("class", "other", "size").agg(
        F.min("doc_id").alias("least"), F.first("bits").alias("bits")), "jaccard-classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    expected = int(total * 0.4) + 1              # keys: two schemes of about 0.18 segments per element
    cells = min(CELLS[1], max(CELLS[0], 1 << (expected // 2).bit_length()))
    bits = share(docs.sparkSession, frequent_cells(own, rule, cells, expected))
    buckets = int(min(MAX_BUCKETS, max(16, expected // BUCKET_KEYS)))
    groups = materialize(candidate_groups(own, rule, bits, buckets), "jaccard-groups")

    words = materialize(words_of(groups.select(F.explode("members").alias("c")).distinct(), own, rule), "jaccard-words")
    links = seen = roots = None

    def verify(pairs):
        """Links among pairs not seen before, added to the links so far."""
        nonlocal links, seen, roots
        pairs = materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "jaccard-pairs")
        if pairs.isEmpty() and seen is not None:
            return
        more = verified(pairs, words, rule)
        links = materialize(more if links is None else links.union(more), "jaccard-links")
        seen = pairs if seen is None else seen.union(pairs)
        roots = materialize(components(links), "jaccard-roots")

    # one pair of each class with a centre, three times: this joins most of what belongs together
    for _ in range(CENTRE_ROUNDS):
        verify(best_pairs(materialize(open_groups(groups, roots), "jaccard-open")))
    # then all pairs that are still open
    verify(open_pairs(open_groups(groups, roots), classes, rule))

    least = classes.groupBy("class").agg(F.min("least").alias("least")).join(roots.withColumnRenamed("node", "class"), "class", "left") \
        .select("class", F.coalesce("root", "class").alias("root"), "least")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(least.join(named, "root").select("class", "component_id"), "jaccard-named")
    return known.select("doc_id", "text_hash", "class", "size").join(named, "class", "left").select(
        "doc_id", "text_hash", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of ``docs`` but for those linked, directly or not, with one of a
    smaller doc_id. Rows without id stay. Rows are told apart by doc_id and
    text."""
    gone = _joined(docs, rule or Rule()).filter("doc_id != component_id") \
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = materialize(gone, "jaccard-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    return rows.join(gone, ["_id", "_hash"], "left_anti").select("row.*")
