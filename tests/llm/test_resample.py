"""Importance resampling against a plain version of its contract."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tetrad.llm import resample as R
from tetrad.llm import words as W
from tetrad.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def buckets(text):
    w = WORD.findall(lower(text))
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target):
    """docs: (doc_id, text). Rows (doc_id, n_features, weight, score, rank)."""
    s, t = [0] * 10000, [0] * 10000
    own = [(i, *buckets(x)) for i, x in docs]
    for _, b, _ in own:
        for x in b:
            s[x] += 1
    for x in target:
        for b in buckets(x)[0]:
            t[b] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (ss + 10000) / ((a + 1) * (tt + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, b, n in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[:len(may) * 5 // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_importance_resampling"](spark, SF_SMALL).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, target), key=key)
    assert any(r[4] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB c1-é\n漢", max_size=40)), min_size=1, max_size=12), st.integers(1, 6))
def test_buckets_of_any_texts(texts, kept):
    features = R.Features(kept=kept)
    features.words.kept = kept
    for _ in range(3):                                    # the dictionary takes words up on the way
        for _, _, data, offsets in W.slices(pa.array(texts, pa.string())):
            bucket, doc, count = features(data, offsets)
        got = [sorted(bucket[doc == i].tolist()) for i in range(len(texts))]
        want = [buckets(x) for x in texts]
        assert got == [sorted(b) for b, _ in want] and count.tolist() == [n for _, n in want]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 255, 256, 257, 70_000, 1_000_003])
def test_crc_of_a_concatenation(n):
    a, b = b"some text", bytes(np.arange(n, dtype=np.int64).astype(np.uint8))
    shift = R.Shift()
    got = shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b)
    assert got == zlib.crc32(a + b)


def test_hostile_rows(spark):
    rows = [(1, None), (2, ""), (None, "w " * 30), (None, "w " * 30), (3, "x" * 5000 + " y " * 25), (4, "A b C " * 9000)] + \
        [(10 + i % 7, f"same words again and again {i % 3} " * 5) for i in range(40)]
    schema = "doc_id long, text string, weight string, n_words int, rank int, row int"
    df = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], schema)
    target = spark.createDataFrame([("again and again",), (None,)], "text string")
    want = brute(rows, ["again and again", None])
    got = [tuple(r) for r in R.resample_report(df, target).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert R.draw(df, target).columns == df.columns
    for a, b in ((df.limit(0), target), (df, target.limit(0)), (df.limit(0), target.limit(0))):
        assert R.resample_report(a, b).count() == a.count()
