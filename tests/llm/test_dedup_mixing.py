"""Exact deduplication and mixing against plain Python."""

import hashlib
import math
import re

import pytest

from tests.conftest import SF_SMALL
from tetrad.llm import exactdedup, mixing
from tetrad.llm.oracle import ORACLE
from tetrad.llm.queries import QUERIES

ROWS = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "a b", "b"), (5, "ab", "b"), (6, " ab", "b"),
        (6, " ab", "b"), (7, "a\u00a0b", "c"), (8, "x " * 50000, "c"), (9, "AB", None), (None, "ab\n\n", None),
        (10, "\x0b\x0ca\rb", "z")]
SCHEMA = "doc_id long, text string, source string, row int, n string"


def frame(spark):
    return spark.createDataFrame([(*r, 1, "n") for r in ROWS], SCHEMA)


@pytest.mark.parametrize("key", ["op7_mixing", "op9_exact_dedup"])
def test_oracle(spark, duck, key):
    from tools.oracle_check import compare
    assert compare(spark, duck, SF_SMALL, key, QUERIES[key], ORACLE[key])["status"] == "ok"


def test_groups_of_hand_made_rows(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    got = exactdedup.duplicate_groups(frame(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        own = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(own)[3], len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert exactdedup.duplicate_groups(frame(spark).limit(0)).count() == 0


def test_rows_that_stay(spark):
    got = exactdedup.deduplicate(frame(spark))
    assert got.columns == frame(spark).columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted(
        [(3, " \t\n"), (7, "a\u00a0b"), (8, "x " * 50000), (9, "AB"), (10, "\x0b\x0ca\rb")])
    same = spark.createDataFrame([(1, "q", "a", 1, "n")] * 5, SCHEMA)
    assert exactdedup.deduplicate(same).count() == 1


def test_filter_merges_without_loss(spark):
    n, keys = 20000, 300
    df = spark.range(n, numPartitions=7).selectExpr(f"xxhash64(id % {keys}) AS fp").union(
        spark.range(50).selectExpr("xxhash64(id + 1000000) AS fp"))
    for bits in (0, 5):
        got = {r.fp: r.n for r in exactdedup.quotient_filter(df, bits).collect()}
        want = {r.fp: r.n for r in df.groupBy("fp").count().withColumnRenamed("count", "n").filter("n > 1").collect()}
        assert got == want and len(got) == keys


def test_mix_targets_and_bounds(spark):
    got = QUERIES["op7_mixing"](spark, SF_SMALL).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    left, target, open_ = sum(sizes.values()), {}, dict(weights)
    while True:                       # reshare until no target is above its limit
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    for s, rs in by.items():
        assert all(math.isclose(r.target, target[s]) and r.source_size == sizes[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= 3 * max(r.size for r in rs)
    again = QUERIES["op7_mixing"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_hand_made_rows(spark):
    got = mixing.mix_report(frame(spark)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    out = mixing.mix(frame(spark))
    assert out.columns == frame(spark).columns
    assert sum(len(re.findall(mixing.WORD, r.text or "")) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(frame(spark).limit(0)).count() == 0
    assert mixing.mix_report(frame(spark).limit(0)).count() == 0
