"""Language-model scores against plain Python."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.conftest import SF_MID
from tetrad.llm import suffixlm
from tetrad.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, got):
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, held(i), len(tokens(t)) + 1, sum(counts[w] > 0 for w in [*tokens(t), None]), n,
                   sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), None])) for i, t in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in want] == [x[:5] for x in have]
    assert np.allclose([x[5] for x in want], [x[5] for x in have], rtol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    got = QUERIES["op8_lm_score"](spark, SF_MID).collect()
    check(rows, got)
    # unseen texts: far better than single bytes, and about the words' own counts
    unseen = {r.doc_id: r for r in got if r.held_out}
    texts = [" ".join(tokens(t)).encode() + b" " for i, t in rows if i in unseen]
    counts = Counter(b"".join(" ".join(tokens(t)).encode() + b" " for i, t in rows if not held(i)))
    n = sum(counts.values())
    single = sum(math.log10((counts[b] + 1) / (n + 252)) for t in texts for b in t)
    score = sum(r.score for r in unseen.values())
    assert score > 0.75 * single and score > 1.15 * sum(r.base_score for r in unseen.values())


def test_hand_made_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a b\tB\x0bc"), (4, "a " * 40000), (None, "a x"), (4, "a"), (4, "a"), (5, "\x00 \x0b é É"),
            *[(i, "the cat the dog") for i in range(10, 40)]]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, block int, score double")
    check(rows, suffixlm.score_documents(df).collect())
    assert suffixlm.score_documents(df.limit(0)).count() == 0
    only = df.filter("doc_id = 4 and length(text) < 3")
    check([(4, "a"), (4, "a")], suffixlm.score_documents(only).collect())


def test_tree_is_a_distribution(spark):
    """Symbols after any context sum to one, and one token matches hand-made arithmetic."""
    df = spark.createDataFrame([("ab ab ac abd",), ("ab",)] * 40, "text string")
    grams = suffixlm._pairs(suffixlm.corpus_counts(df, 4).filter("kind = 1"))
    t = suffixlm.SuffixTree(suffixlm.context_tree(grams).toArrow())
    assert len(t.ctx) > 1
    for prefix in (b"", b"a", b"ab", b"q", b"qa", b"abdq"):
        symbols = [x for x in range(256) if x not in (0x20, *range(0x09, 0x0E))]
        token = [np.frombuffer(prefix + bytes([x]), np.uint8) for x in symbols]
        key, _ = suffixlm.windows(np.concatenate(token), np.array([len(x) for x in token]))
        key = key.reshape(len(symbols), -1)[:, len(prefix)]          # the window of the added byte
        stop, _ = suffixlm.windows(np.frombuffer(prefix, np.uint8), np.array([len(prefix)]))
        total = (10 ** t.score(key)).sum() + 10 ** t.score(stop[-1:])[0]
        end = np.array([(int(key[0]) >> 8 << 8) | suffixlm.END], np.uint64)
        assert math.isclose(total + 10 ** t.score(end)[0], 1, rel_tol=1e-9)


def test_contexts_do_not_depend_on_the_corpus_size(spark):
    """A context of a rare language is kept however long the other texts are."""
    rows = []
    for token, n in ((b"the", 10 ** 9), (b"zq", 1000)):
        key, _ = suffixlm.windows(np.frombuffer(token, np.uint8), np.array([len(token)]))
        rows += [(int(k), n) for k in key]
    tree = suffixlm.context_tree(spark.createDataFrame(rows, "key long, n long"))
    kept = {(r.depth, r.ctx & (1 << suffixlm._BITS) - 1) for r in tree.collect()}
    assert {(1, ord("h")), (1, ord("z")), (1, ord("q"))} <= kept


def test_scores_by_table_are_those_of_the_whole_tree(spark, monkeypatch):
    """With every window looked up in its bucket, against one tree in memory."""
    monkeypatch.setattr(suffixlm, "LIKELY", 0)
    rows = [(i, " ".join(f"word{(i * k) % 17} and" for k in range(1, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.filter(df.doc_id.isin([i for i, _ in rows if not held(i)]))
    tree = suffixlm.SuffixTree(suffixlm.context_tree(suffixlm._pairs(suffixlm.corpus_counts(train, 4).filter("kind = 1"))).toArrow())
    got = {r.doc_id: r.score for r in suffixlm.score_documents(df).collect()}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        starts, ends, doc = suffixlm.W.spans(data, np.array([0, len(data)]), suffixlm.W.SPACE)
        keys = np.concatenate([k for k, _ in suffixlm.document_windows(data, starts, ends, doc, 1)])
        assert math.isclose(got[i], tree.score(keys).sum(), rel_tol=1e-9)


def test_shuffled_words_score_lower(spark):
    words = "one small cat saw two big dogs near an old red barn".split()
    rows = [(i, " ".join(words)) for i in range(200)]
    mixed = np.random.default_rng(5)
    rows += [(1000 + i, " ".join(mixed.permutation(words))) for i in range(60) if held(1000 + i)]
    got = {r.doc_id: r.score for r in suffixlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shuffled = [v for i, v in got.items() if i >= 1000]
    assert shuffled and max(shuffled) < got[0] - 3


def test_frequent_keys_stand_in_the_first_slots():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 60_000):
        keys = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        rng.shuffle(keys)
        values = rng.random(len(keys))
        table = suffixlm._Table(keys, values)
        other = np.setdiff1d(rng.integers(0, 1 << 56, 1000).astype(np.uint64), keys)
        got, there = table.find(np.concatenate([other, keys, other]))
        assert there.sum() == len(keys) and there[len(other):len(other) + len(keys)].all()
        assert np.array_equal(got, np.concatenate([np.zeros(len(other)), values, np.zeros(len(other))]))
    shift, slots = table.levels[0]
    pairs = slots.view(np.uint64).reshape(-1, 2)
    first = pairs[(suffixlm.W.mix(keys) >> shift).astype(int), 0] == keys
    assert first[-6000:].mean() > 0.95 > first.mean()    # the last ones given keep their slots
    assert len(table.more) < len(keys) // 50             # nearly nothing is left for the binary search


def test_buckets_keep_the_order_of_keys():
    b = np.array([65535, 0, 3, 0, 65535, 3])
    assert suffixlm._by_bucket(b).tolist() == [1, 3, 2, 5, 0, 4]
    assert suffixlm.MAX_BUCKETS <= 1 << 16


def test_windows_are_counted_in_packed_form(monkeypatch):
    """Counts around and far above a byte, over several merges and flushes."""
    monkeypatch.setattr(suffixlm, "NEW_WINDOWS", 1000)
    rng = np.random.default_rng(5)
    often = [(np.uint64(255 << 48 | k), k) for k in (1, 254, 255, 256, 509, 510, 511, 70_000)]
    keys = np.concatenate([np.full(n, k, np.uint64) for k, n in often] + [rng.integers(0, 1 << 56, 5000).astype(np.uint64)])
    want = Counter(keys.tolist())
    rng.shuffle(keys)
    for flush in (10, 2000, 1 << 30):
        monkeypatch.setattr(suffixlm, "FLUSH_WORDS", flush)
        counts, got, rows = suffixlm._WindowCounts(), Counter(), []
        for piece in np.array_split(keys, 100):
            counts.see(piece)
            rows += counts.rows(1, 7)
        assert bool(rows) == (flush < 1 << 30)
        for b in [*rows, *counts.rows(1, 7, last=True)]:
            for k, n in zip(b.column("keys"), b.column("counts")):
                k = suffixlm._unpack_keys(k.as_py())
                assert (k[1:] > k[:-1]).all()
                got.update(dict(zip(k.tolist(), suffixlm._unpack(n.as_py(), np.int64).tolist())))
        assert got == want and not [*counts.rows(1, 7, last=True)]
    monkeypatch.setattr(suffixlm, "FLUSH_WORDS", 100)
    counts.see(np.full(100_000, 7, np.uint64))          # one window far more often than may be held
    assert len([*counts.rows(1, 7)]) == 1 and counts.size == 0


def test_lists_are_copied_as_a_whole():
    values = [np.arange(1_500_000), np.zeros(0, np.int64), np.arange(5)]
    start = time.process_time()
    got = suffixlm._lists(values, pa.int64())
    assert time.process_time() - start < 0.25            # one value at a time: more than a second
    assert got.type == pa.list_(pa.int64()) and [len(x.values) for x in got] == [1_500_000, 0, 5]
    assert got[2].as_py() == [0, 1, 2, 3, 4] and np.array_equal(got[0].values.to_numpy(), values[0])
    assert suffixlm._lists([pa.array([7, None, 8, 9])[1:3]], pa.int64()).to_pylist() == [[None, 8]]
    assert suffixlm._lists([], pa.bool_()).type == pa.list_(pa.bool_())
