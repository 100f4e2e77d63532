"""Components of the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from tetrad.llm import jaccard
from tetrad.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in index[g] if j < i)
        for j, k in shared.items():
            if 100 * k >= 85 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(map(str, ((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))))


def found(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("frequent", [2, 8])
def test_documents(spark, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    d = SF_MID if frequent == 8 else SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows)
    assert found(QUERIES["op10_ngram_jaccard"](spark, d)) == want
    assert len({w.rsplit(",")[-1] for w in want}) < len(rows)


@pytest.mark.parametrize("frequent", [1, 3, 50])
def test_near_copies_of_all_sizes(spark, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(frequent)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows, i = [], 0
    for size in [1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 14, 15, 17, 20, 23, 26, 30, 40, 60, 100, 250, 700]:
        for _ in range(2):
            base = rng.choices(vocabulary, k=size) + (passage if rng.random() < 0.5 else [])
            for _ in range(8):
                w = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(w) // 40)])):
                    at = rng.randrange(len(w))
                    how = rng.random()
                    if how < 0.4:
                        w[at] = rng.choice(vocabulary)
                    elif how < 0.7 and at > len(w) - 4:
                        del w[at:]
                    else:
                        w.append(rng.choice(vocabulary))
                    w = w or ["x"]
                rows.append((i, " ".join(w)))
                i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(jaccard.join_components(df)) == brute(rows)


def test_hand_made_rows(spark):
    long = " ".join(f"a{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (5, "one two"), (6, "One two three"), (7, long),
            (8, long + " more"), (None, long), (None, None), (9, "a a a a a a a a a"), (10, "A a a a"), (11, "é x y z w"), (12, "É x y z w")]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id long, text string, class int, bits string, size int")
    assert found(jaccard.join_components(df)) == brute(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 11, 12]
    two = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (2, "quite another text here")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.keep_one(two).collect()) == ["a b c d e", "quite another text here"]
    assert jaccard.join_components(df.limit(0)).count() == 0
    assert jaccard.join_components(df.filter("doc_id < 4")).count() == 3


def test_components_of_chains_and_stars(spark):
    from tetrad.llm.components import components
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 150), (7, 7), (-5, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == -5 for i in [*range(100, 160), 200])


def test_bitmap_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 5000, rng.integers(1, 900))).astype(np.uint64) for _ in "ab")
        bits = [jaccard._bitmaps(x, np.zeros(len(x), np.int64), 1) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def template_texts(n, seed=5):
    """A family from one template: three of thirty places filled."""
    rng = random.Random(seed)
    fixed = [f"t{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = list(fixed)
        for place in rng.sample(range(30), 3):
            w[place * 10] = f"v{rng.randrange(40)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block, family", [(3, 5), (7, 1 << 20), (1, 40)])
def test_groups_in_tiles(spark, block, family, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FAMILY_MEMBERS", family)
    monkeypatch.setattr(jaccard, "CENTRE_ROUNDS", 0)
    rows = template_texts(60) + [(100 + i, t) for i, t in template_texts(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(jaccard.join_components(df)) == brute(rows)


@pytest.mark.parametrize("block", [1, 4, 10, 4096])
def test_tiles_give_every_pair_once(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    groups = {1: range(0, 30), -2: range(20, 50), 3: [60, 61], 4: range(70, 80)}
    root = {c: c // 3 * 3 for g in groups.values() for c in g}
    member = spark.createDataFrame([(i, c, root[c]) for i, g in groups.items() for c in g], "id long, c long, root long")
    classes = spark.createDataFrame([(c, 100, bytes(jaccard.BITMAP // 8)) for c in root], "class long, size long, bits binary")
    got = sorted((r.a, r.b) for r in jaccard.open_pairs(member, classes, jaccard.Rule()).collect())
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b and root[a] != root[b]}
    assert got == sorted(want)


def test_tiles_hold_two_blocks_at_most(spark, monkeypatch):
    """A group of many blocks: no row of the plan has more than two blocks' members."""
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    seen = spark.sparkContext.accumulator(0)
    widest = jaccard._cross_pairs

    def watched(batches, rule):
        def through():
            for b in batches:
                sizes = np.diff(b.column("g").offsets.to_numpy())
                seen.add(int((sizes > 4 * 50).sum()))
                yield b
        return widest(through(), rule)
    monkeypatch.setattr(jaccard, "_cross_pairs", watched)
    member = spark.range(1000).select(F.lit(9).cast("long").alias("id"), F.col("id").alias("c"), F.col("id").alias("root"))
    classes = spark.range(1000).select(F.col("id").alias("class"), F.lit(100).cast("long").alias("size"),
                                       F.lit(bytes(jaccard.BITMAP // 8)).alias("bits"))
    assert jaccard.open_pairs(member, classes, jaccard.Rule()).count() == 1000 * 999 // 2
    assert seen.value == 0


def test_frequent_cells_are_those_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    rule, cells = jaccard.Rule(), 1 << 16
    df = spark.createDataFrame(template_texts(40), "doc_id long, text string").coalesce(1)
    bits = jaccard.frequent_cells(df, rule, cells, 1)
    counts = np.zeros(cells, int)
    for s, doc, at, _, new in jaccard._first_seen(df.select("text").toArrow().to_batches(), rule):
        for _, content, tag, _, _, _ in jaccard.segment_keys(s, doc, at, rule, new):
            counts += np.bincount(jaccard._cells(jaccard._keys(content, tag), cells), minlength=cells)
    assert len(bits) * 8 == cells and (counts >= 5).any()
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == (counts >= 5)).all()
