"""Approximate nearest neighbours by cross-polytope hashing.

Nearness is the inner product. A vector x becomes a unit vector by one more
coordinate, (x, sqrt(M^2 - |x|^2)) / M with M the largest norm; a query is scaled
to length one. A hash applies three rounds of random signs and a fast Hadamard
transform and takes the nearest signed axis; a table's bucket is made of one or
more hashes. Queries probe the buckets of each table in order of nearness.

How many buckets to probe is measured: for a bounded sample of queries the true
neighbours are found by brute force, and the probes are as few as give them the
recall ``TARGET``. If ``MOST_PROBES`` do not, the tables are made of one hash less. Vectors are compared in blocks: a bucket (split into parts if
it is large) against the queries that probe it. A block returns for each query
its best few, and only those that reach the query's best few so far: of a fixed
sample of vectors, which are candidates as well, then also of the nearest
buckets, which are probed first. This loses nothing.

Equal vectors are one class with its smallest ids; a query's own id is left out
at the end. Defined cases: vectors that are null, zero, hold a null or
non-finite component, or differ in length from most, and rows with a null id
take no part. Repeated rows count once; an id with several vectors is several
candidates of which the best is returned. With fewer candidates than asked, all
are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm.common import share
from tetrad.session import materialize

TABLES, ROUNDS, SEED = 4, 3, 7
#: recall that the sampled queries must reach, their number, and vectors of the fixed sample
TARGET, SAMPLE_QUERIES, SAMPLE_VECTORS = 0.96, 256, 4096
#: probes per table that raise each query's floor before the others are made
FIRST_PROBES = 4
#: classes of a bucket in one block, and of queries
BLOCK, BLOCK_QUERIES = 8192, 2048
#: vectors per bucket from which on a table takes one more hash
BUCKET = 1 << 16
#: probes per table above which a table takes one hash less; with one hash all buckets may be probed
MOST_PROBES = 4096
#: scores of buckets made at once
SCORES = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix (fast transform)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hash:
    """The tables' rotations for vectors of ``dim`` components."""

    def __init__(self, dim: int, largest: float, n: int, tables: int = TABLES, most: int | None = None):
        """Tables for ``n`` vectors, of ``most`` hashes at most."""
        self.dim, self.largest = dim, largest
        self.width = 1 << dim.bit_length()           # a power of two above dim
        self.each = 1
        while n / (2 * self.width) ** self.each > BUCKET and self.each != most:
            self.each += 1
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], (tables, self.each, ROUNDS, self.width))

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = hadamard(x * s)
        return x

    def _padded(self, x, last):
        out = np.zeros((len(x), self.width))
        out[:, :self.dim], out[:, self.dim] = x, last
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of every vector in every table (rows: vectors)."""
        x = x / self.largest
        x = self._padded(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1))))
        out = np.zeros((len(x), len(self.signs)), np.int64)
        for t, table in enumerate(self.signs):
            for signs in table:
                y = self._rotated(x, signs)
                axis = np.abs(y).argmax(1)
                out[:, t] = out[:, t] * 2 * self.width + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of every query in every table, best first
        (queries, tables, probes); fewer where a table has fewer."""
        step = max(1, SCORES // (2 * self.width) ** min(self.each, 2))
        return np.concatenate([self._probes(q[a:a + step], n) for a in range(0, max(1, len(q)), step)])

    def _probes(self, q: np.ndarray, n: int) -> np.ndarray:
        q = self._padded(q / np.sqrt((q * q).sum(1, keepdims=True)), 0)
        codes = 2 * self.width
        n = min(n, codes ** self.each)
        out = np.zeros((len(q), len(self.signs), n), np.int64)
        for t, table in enumerate(self.signs):
            total = code = None
            for signs in table:
                y = self._rotated(q, signs)
                s = np.stack([y, -y], 2).reshape(len(q), codes)
                c = np.broadcast_to(np.arange(codes), s.shape)
                if total is not None:                # best sums of the hashes so far and this one
                    c = (code[:, :, None] * codes + c[:, None, :]).reshape(len(q), -1)
                    s = (total[:, :, None] + s[:, None, :]).reshape(len(q), -1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :n]
                total, code = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)
            out[:, t, :code.shape[1]] = code[:, :n]
        return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))


def _best(q: np.ndarray, x: np.ndarray, cid: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, vector row, score) of the k best of each query: by score
    down, then smaller id; scores summed alike everywhere."""
    rows, cols, scores = [], [], []
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ x.T
        slack = 1e-9 * (1 + np.abs(s).max(1, initial=0))
        least = np.full(len(s), -np.inf)
        if len(x) > k:
            least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        if floor is not None:
            least = np.maximum(least, floor[a:a + 256])
        r, c = np.nonzero(s >= (least - slack)[:, None])
        exact = (q[a + r] * x[c]).sum(1)
        order = np.lexsort((cid[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        rows.append(a + r[keep])
        cols.append(c[keep])
        scores.append(exact[keep])
    return (np.concatenate(z) if z else np.zeros(0, int) for z in (rows, cols, scores))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: cid (smallest id), ids (the k + 1 smallest), vec."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")) \
        .select(F.col("ids")[0].alias("cid"), "ids", "vec")


def valid(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct (vec_id, vec) of the rows that take part."""
    big = F.lit(float("inf"))
    t = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")) \
        .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)) \
        .filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))) \
        .filter(F.exists("vec", lambda v: v != 0))
    n = t.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return t.filter(F.size("vec") == (n.d if n else 0)).distinct()


def _truth(classes: DataFrame, sample, hashes, k: int) -> DataFrame:
    """For each sampled query the buckets of its true k nearest other classes."""
    def run(batches):
        cid, q = sample.value
        for b in batches:
            x, own = _matrix(b.column("vec")), b.column("cid").to_numpy()
            r, c, s = _best(q, x, own, k + 1)
            r, c, s = (z[cid[r] != own[c]] for z in (r, c, s))
            codes = hashes.value.buckets(x[np.unique(c)])[np.searchsorted(np.unique(c), c)] if len(c) else np.zeros((0, 1), int)
            yield pa.record_batch({"q": pa.array(r), "cid": pa.array(own[c]), "score": pa.array(s.astype(np.float64)),
                                   "codes": pa.array(codes.tolist(), pa.list_(pa.int64()))})
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    return classes.select("cid", "vec").mapInArrow(run, "q long, cid long, score double, codes array<long>") \
        .withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("q", "codes")


def probes_needed(truth: pa.Table, q: np.ndarray, hashes: Hash, target: float) -> int | None:
    """Fewest probes per table that find ``target`` of the true neighbours; none
    if MOST_PROBES are too few."""
    most = 2 * hashes.width if hashes.each == 1 else MOST_PROBES
    order, least = hashes.probes(q, most), []
    for i, codes in zip(truth.column("q").to_pylist(), truth.column("codes").to_pylist()):
        hit = [np.flatnonzero(order[i, t] == c) for t, c in enumerate(codes)]
        least.append(min((int(h[0]) for h in hit if len(h)), default=most))
    if not least:
        return 1
    needed = int(np.sort(least)[min(len(least) - 1, int(np.ceil(target * len(least))))]) + 1
    return needed if needed <= order.shape[2] else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    ``vectors`` and ``queries``: (vec_id, vec) as from ``valid``; the queries
    are among the vectors.
    """
    spark = vectors.sparkSession
    classes = materialize(_classes(vectors, k), "ann-classes")
    head = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"),
                       F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not head.n:
        return spark.createDataFrame([], out)
    asked = queries.join(classes.select("cid", "vec"), "vec").select("vec_id", "cid", "vec")
    asked = materialize(asked, "ann-asked")
    distinct = materialize(asked.groupBy("cid").agg(F.first("vec").alias("vec")), "ann-queries")

    def drawn(df, n):
        t = df.select("cid", "ids", "vec") if "ids" in df.columns else df
        t = t.orderBy(F.xxhash64("cid"), "cid").limit(n).toArrow()
        return t.column("cid").to_numpy(), _matrix(t.column("vec")), t
    cid, q, _ = drawn(distinct, SAMPLE_QUERIES)
    if not len(cid):
        return spark.createDataFrame([], out)
    asking, probes, most = share(spark, (cid, q)), None, None
    while probes is None:                                 # with one hash per table every bucket can be reached
        hashes = share(spark, Hash(head.d, float(np.sqrt(head.m)) * (1 + 1e-12), head.n, most=most))
        probes, most = probes_needed(_truth(classes, asking, hashes, k).toArrow(), q, hashes.value, TARGET), hashes.value.each - 1
    cid, x, t = drawn(classes, SAMPLE_VECTORS)
    fixed = share(spark, (cid, x, t.column("ids").combine_chunks()))

    def bucketed(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            codes = hashes.value.buckets(x)
            for t in range(codes.shape[1]):
                yield pa.record_batch({"tab": pa.array(np.full(len(x), t, np.int32)), "bucket": pa.array(codes[:, t]),
                                       "cid": b.column("cid"), "ids": b.column("ids"), "vec": _vectors(x)})
    data = materialize(classes.mapInArrow(bucketed, "tab int, bucket long, cid long, ids array<long>, vec array<double>"), "ann-data")
    # a large bucket is split into parts
    sizes = data.groupBy("tab", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    many = {(r.tab, r.bucket): r.parts for r in sizes.filter("parts > 1").collect()}
    parts = share(spark, many)
    split = spark.createDataFrame([(*a, int(b)) for a, b in many.items()], "tab int, bucket long, parts int")
    data = data.join(F.broadcast(split), ["tab", "bucket"], "left") \
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int"))
    groups = max(1, -(-distinct.count() // BLOCK_QUERIES))

    found_schema = "q long, cid long, ids array<long>, score double"

    def start(batches):
        cid, x, ids = fixed.value
        for b in batches:
            q = _matrix(b.column("vec"))
            r, c, s = _best(q, x, cid, k + 1)
            yield pa.record_batch({"q": pa.array(b.column("cid").to_numpy()[r]), "cid": pa.array(cid[c]),
                                   "ids": ids.take(pa.array(c)), "score": pa.array(s.astype(np.float64))})
    started = materialize(distinct.mapInArrow(start, found_schema), "ann-start")
    key = ["tab", "bucket", "part", "side"]
    data = data.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else data.withColumn("side", F.lit(0))
    data = data.select(*key, "cid", "ids", "vec")

    def block(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()),
                             "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        cid = x.column("cid").to_numpy()
        r, c, s = _best(_matrix(q.column("vec")), _matrix(x.column("vec")), cid, k + 1, q.column("floor").to_numpy())
        return pa.table({"q": pa.array(q.column("q").to_numpy()[r]), "cid": pa.array(cid[c]),
                         "ids": x.column("ids").combine_chunks().take(pa.array(c)), "score": pa.array(s.astype(np.float64))})

    def best(pairs):
        """Each query's best k + 1 classes."""
        w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
        once = pairs.groupBy("q", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("q", "cid", "ids", "score")

    def search(top, first, last):
        """``top`` with what the probes ``first`` to ``last`` of each table find.
        No vector below a query's k + 1 best so far can be among its nearest."""
        def probing(batches):
            for b in batches:
                q = _matrix(b.column("vec"))
                step = max(1, min(64, (1 << 16) // (TABLES * last)))
                for a in range(0, len(q), step):
                    own = hashes.value.probes(q[a:a + step], last)[:, :, first:]
                    row, tab, _ = (z.ravel() for z in np.indices(own.shape))
                    bucket = own.ravel()
                    n = np.array([parts.value.get(z, 1) for z in zip(tab.tolist(), bucket.tolist())], np.int64)
                    rep = np.repeat(np.arange(len(row)), n)
                    part = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                    row, tab, bucket = a + row[rep], tab[rep], bucket[rep]
                    yield pa.record_batch({
                        "tab": pa.array(tab.astype(np.int32)), "bucket": pa.array(bucket), "part": pa.array(part.astype(np.int32)),
                        "q": b.column("cid").take(pa.array(row)), "floor": b.column("floor").take(pa.array(row)),
                        "vec": b.column("vec").take(pa.array(row))})
        floors = top.groupBy("q").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")) \
            .select("q", F.when(F.col("n") > k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
        probe = distinct.join(floors, distinct["cid"] == floors["q"]).select("cid", "vec", "floor") \
            .mapInArrow(probing, "tab int, bucket long, part int, q long, floor double, vec array<double>")
        # the queries of a block are split too; its vectors go to each part
        probe = probe.withColumn("side", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(groups)).cast("int"))
        found = data.groupBy(*key).cogroup(probe.groupBy(*key)).applyInArrow(block, found_schema)
        return materialize(best(found.union(top)), "ann-top")

    pairs = started
    for first, last in ((0, min(FIRST_PROBES, probes)), (FIRST_PROBES, probes)):
        if first < last:                                  # the nearest buckets raise the floors for the others
            pairs = search(pairs, first, last)
    each = pairs.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = materialize(each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits")), "ann-lists")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")).distinct().join(lists, "q") \
        .select("query_id", F.posexplode(others).alias("p", "h")) \
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def nearest_of_every(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by ``every``, among all."""
    vectors = valid(table)
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
