"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from tests.conftest import SF_MID
from tetrad.llm import ann
from tetrad.llm.queries import QUERIES


def brute(ids, x, q, k):
    s = (x[q] * x).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [(int(ids[i]), s[i]) for i in order[:k]]


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in QUERIES["op1_cross_polytope"](spark, SF_MID).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hit = 0
    for i, own in got.items():
        want = brute(ids, x, int(np.flatnonzero(ids == i)[0]), 20)
        hit += len({v for v, _ in want} & {r.vec_id for r in own})
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == (x[ids == i][0] * x[ids == r.vec_id][0]).sum() for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
    assert hit / (20 * len(got)) >= 0.9


def test_larger_than_the_fixed_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) * rng.choice([0.5, 1, 3], (1500, 1))
    x[200:500] = x[7]                                         # one very common vector
    ids = np.arange(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids.tolist(), x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_of_every(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for i in range(0, 1500, 20):
        want = brute(ids, x, i, 20)
        assert len(got[i]) == 20
        hit += len({v for v, _ in want} & {v for v, _ in got[i]})
        if 200 <= i < 500 and want[0][1] == want[19][1]:
            assert [v for v, _ in got[i]] == [v for v, _ in want]
    assert hit / (20 * 75) >= 0.9


def test_hand_made_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]),
            (5, [1.0, inf]), (6, [1.0, None]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (60, []), (8, [-1.0, -0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = [tuple(r) for r in ann.nearest_of_every(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (0, 3, 8, -1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 8, -0.5)]
    assert ann.nearest_of_every(df.limit(0)).count() == 0
    assert ann.nearest_of_every(df.filter("vec_id = 1")).count() == 0


def test_two_hashes_probe_nearest_first():
    h = ann.Hash(5, 1.0, 10, tables=2)
    h.each, h.signs = 2, np.random.default_rng(0).choice([-1.0, 1.0], (2, 2, 3, h.width))
    x = np.random.default_rng(1).normal(size=(30, 5))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    own, probes = h.buckets(x), h.probes(x, 10)
    assert (probes[:, :, 0] == own).mean() > 0.95             # a unit vector's own bucket is its nearest (but for ties)
    assert all(len(set(p)) == 10 for q in probes.tolist() for p in q)
    assert h.probes(x, 10**6).shape[2] == (2 * h.width) ** 2
    y = ann.hadamard(np.eye(8))
    assert np.allclose(y @ y.T, np.eye(8))


@pytest.mark.parametrize("most", [16, 4096])
def test_recall_with_two_hashes(spark, monkeypatch, most):
    """Tables of two hashes by size: with probes enough, and with too few."""
    monkeypatch.setattr(ann, "BUCKET", 10)
    monkeypatch.setattr(ann, "SAMPLE_VECTORS", 30)
    monkeypatch.setattr(ann, "MOST_PROBES", most)
    x = np.random.default_rng(4).normal(size=(900, 12))
    assert ann.Hash(12, 10.0, 900).each == 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_of_every(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len({v for v, _ in brute(np.arange(900), x, i, 20)} & got[i]) for i in range(0, 900, 20))
    assert hit / (20 * 45) >= 0.9
