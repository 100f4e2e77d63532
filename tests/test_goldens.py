"""Small hand-made goldens for the semantics the reference defines."""

import math
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import arrays as A
from tetrad.functions import text as T
from tetrad.operators import metrics, scoring, wordpiece
from tetrad.operators.piecetrie import PieceTrie
from tetrad.sources import posts as posts_src
from tetrad.sources import vocab as vocab_src


def test_parse_answer_strips_before_cutting(spark):
    df = spark.createDataFrame([
        ("x [MBTI]\n intj<|endoftext|>",),
        ("x [MBTI]\nintj <|endoftext|>",),     # space before the end marker stays
        ("x [MBTI] a [MBTI]\nenfp<|endoftext|>",),  # last marker wins
        ("x [MBTI]\nintj",),                   # no end marker
        ("intj<|endoftext|>",),                # no answer marker
    ], "g string")
    got = [r.a for r in df.select(T.parse_answer("g").alias("a")).collect()]
    assert got == ["intj", "intj ", "enfp", None, None]


def test_histogram_counts_letters_right(spark):
    df = spark.createDataFrame([("intj", "intj"), ("intp", "intj"), ("estp", "intj"),
                                ("esfp", "intj"), ("in", "intj")], "answer string, gold string")
    h = {r.k: r.exactly_k_correct for r in metrics.match_histogram(df).collect()}
    # intj 4, intp 3, estp 1 (t), esfp 0; a wrong-length answer counts in no bucket
    assert h == {0: 1, 1: 1, 2: 0, 3: 1, 4: 1}


def test_wrong_length_scores_zero_letters(spark):
    df = spark.createDataFrame([("in", "intj", "intj"), (None, "intj", "intp")],
                               "answer string, gold string, naive string")
    m = metrics.generation_metrics(df).first()
    assert m.accuracy == 0 and m.mean_match == 0
    assert m.naive_accuracy == 50 and m.naive_mean_match == 87.5


def test_double_softmax_floor(spark):
    df = spark.createDataFrame([([1.0] + [0.0] * 15, 0)], "p array<double>, t int")
    ce = df.select(A.double_softmax_ce("p", F.col("t")).alias("ce")).first().ce
    assert math.isclose(ce, math.log((math.e + 15) / math.e), rel_tol=1e-12)


def test_ranking_ties_keep_lower_index(spark):
    df = spark.createDataFrame([(1, "intp", [0.1] * 16)], "post_id long, gold string, p array<double>")
    r = scoring.predictions(df).first()
    assert r.answer == "intj" and r.ranking == dims.CLASS_NAMES and r.gold_rank == 2


def test_axis_tie_goes_to_first_letter(spark):
    df = spark.createDataFrame([(1, [0.5, 0.9, 0.1, 0.5])], "post_id long, p1 array<double>")
    r = scoring.compose_axes(df).first()
    assert r.bits == "0100" and r.answer == "istj"


def test_first_words_keeps_empty_words(spark):
    df = spark.createDataFrame([("a  b\nc d",)], "t string")
    assert df.select(T.first_words("t", 3).alias("w")).first().w == "a  b\nc"


def test_rejects_null_and_unknown(spark):
    df = spark.createDataFrame([(1, None, "INTJ"), (2, "x", "ABCD"), (3, "y", " enfp "), (4, "z", "ISTP")],
                               "post_id long, posts string, type string")
    valid, rej = posts_src.validate(df, spark)
    assert {(r.post_id, r.reason) for r in rej.collect()} == {(1, "null_post"), (2, "unknown_type")}
    assert {(r.post_id, r.type, r.target) for r in valid.collect()} == {(3, "ENFP", 11), (4, "ISTP", 5)}


def _csv(path, text):
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_fields(spark, tmp_dir):
    _csv(f"{tmp_dir}/posts.csv", 'posts,type\n"hello, world",INTJ\n"two\nlines ""quoted""",ENFP\n,ISTP\nNA,ISTP\n'
                                 'null,ESFP\nx,null\nNAN,INTP\n"hello, world",INTJ\n')
    rows = posts_src.read_posts_csv(spark, f"{tmp_dir}/posts.csv").collect()
    assert sorted((r.posts or "", r.type or "") for r in rows) == sorted([
        ("hello, world", "INTJ"), ("hello, world", "INTJ"), ('two\nlines "quoted"', "ENFP"), ("", "ISTP"), ("", "ISTP"),
        ("", "ESFP"), ("x", ""), ("NAN", "INTP")])
    assert len({r.post_id for r in rows}) == 8


def test_csv_ids_do_not_depend_on_files(spark, tmp_dir):
    rows = [f'"post {i % 90}, text",INTJ' for i in range(120)]
    _csv(f"{tmp_dir}/one/a.csv", "posts,type\n" + "\n".join(rows))
    for k in range(3):
        _csv(f"{tmp_dir}/three/{k}.csv", "posts,type\n" + "\n".join(rows[k::3]))
    ids = [sorted((r.post_id, r.posts) for r in posts_src.read_posts_csv(spark, f"{tmp_dir}/{d}").collect()) for d in ("one", "three")]
    assert ids[0] == ids[1] and len(set(ids[0])) == 120


def test_malformed_csv_rows_are_rejected(spark, tmp_dir):
    _csv(f"{tmp_dir}/bad.csv", "posts,type\ngood,INTJ\nonly one field\na,b,c\n,ISTP\n")
    valid, rej = posts_src.validate(posts_src.read_posts_csv(spark, f"{tmp_dir}/bad.csv"), spark)
    assert [(r.posts, r.type) for r in valid.collect()] == [("good", "INTJ")]
    assert sorted(r.reason for r in rej.collect()) == ["malformed", "malformed", "null_post"]
    assert {"only one field", "a,b,c"} <= {r.posts for r in rej.collect()}


def test_null_texts_are_neither_counted_nor_drawn(spark):
    from tetrad.operators import sampling
    rows = [(i, None if i % 2 else f"t{i}", dims.CLASS_NAMES[i % 16].upper() if i % 32 < 16 else dims.CLASS_NAMES[(i + 1) % 16].upper())
            for i in range(640)]
    posts = spark.createDataFrame(rows, "post_id long, posts string, type string")
    ids = posts.select("post_id", "type", F.col("posts").isNotNull().alias("has_text"))
    for f in (sampling.class_counts, lambda p: sampling.resample(p, dims.priors(spark, "bal")).select("post_id")):
        assert sorted(f(posts).collect()) == sorted(f(ids).collect())
    drawn = sampling.resample(posts, dims.priors(spark, "bal"))
    assert drawn.where("posts is null").count() == 0


def _py_wordpiece(word, vocab, unk="[UNK]", max_chars=None):
    if max_chars is not None and len(word) > max_chars:
        return [unk]
    out, start = [], 0
    while start < len(word):
        end, cur = len(word), None
        while start < end:
            piece = word[start:end] if start == 0 else "##" + word[start:end]
            if piece in vocab:
                cur = piece
                break
            end -= 1
        if cur is None:
            return [unk]
        out.append(cur)
        start = end
    return out


def test_wordpiece_equals_greedy_loop(spark):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "p", "l", "a", "y", "i", "n", "g",
              "play", "pl", "##ing", "##aying", "##layin", "##g", "##n", "##i", "un", "##play"]
    vocab = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int")
    words = ["playing", "play", "unplaying", "x", "pl", "playi", "gig", "a" * 120]
    wdf = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: [pieces[i] for i in r.ids] for r in wordpiece.tokenize_words(wdf, vocab).collect()}
    want = {w: _py_wordpiece(w, set(pieces)) for w in words}
    assert got == want
    capped = {r.w: [pieces[i] for i in r.ids] for r in wordpiece.tokenize_words(wdf, vocab, max_chars=100).collect()}
    assert capped == {w: _py_wordpiece(w, set(pieces), max_chars=100) for w in words}


def _py_device(word, pieces):
    """The phone's loop, place by place."""
    if word in pieces:
        return [pieces[word]]
    out = []
    for cut in range(len(word) - 1, 0, -1):
        if word[:cut] in pieces:
            out.append(pieces[word[:cut]])
            at, end = cut, len(word)
            while True:
                fits = [k for k in range(at + 1, end + 1) if "##" + word[at:k] in pieces]
                if not fits:
                    break
                out.append(pieces["##" + word[at:fits[-1]]])
                at, end = fits[-1], len(word) - 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab#", min_size=1, max_size=5), max_size=14), st.text(alphabet="ab#c", min_size=1, max_size=14))
def test_trie_equals_greedy_loop(pieces, word):
    """Any vocabulary (pieces that begin with the mark among them) and word."""
    vocab = ["[UNK]", *dict.fromkeys(p for x in pieces for p in (x, "##" + x))]
    vocab = vocab[: 1 + len(vocab) * 2 // 3]
    trie = PieceTrie({p: i for i, p in enumerate(vocab)}, 0)
    assert [vocab[i] for i in trie.greedy(word)] == _py_wordpiece(word, set(vocab))
    assert trie.device(word) == _py_device(word, {p: i for i, p in enumerate(vocab)})


def test_words_of_any_length():
    """A word of a megabyte takes under a second, matched or not."""
    trie = PieceTrie({p: i for i, p in enumerate(["[UNK]", "a", "##a", "##aa", "##aaaaaaaaab", "b", "##" + "a" * 60])}, 0)
    for word, n in (("a" * 1_000_000, 1 + 999_999 // 60 + (39 + 1) // 2), ("a" * 1_000_000 + "c", 1)):
        t = time.time()
        assert len(trie.greedy(word)) == n and time.time() - t < 1
    assert len(trie.device("a" * 200_000 + "c")) > 1000


def test_long_words_in_a_table(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("x", 4), ("##x", 5)], "piece string, id int")
    posts = spark.createDataFrame([(1, "x" * 500_000 + " x"), (2, "y" * 300_000)], "post_id long, posts string")
    got = {r.post_id: r.ids for r in wordpiece.encode_posts(posts, vocab).collect()}
    assert got == {1: [2, 4, *[5] * 509, 3], 2: [2, 1, 3]}


def test_alternating_vocabularies(spark):
    """Facts of a vocabulary never come from another one."""
    for k in range(6):
        extra = ["zz" * (k + 1)]
        pieces = ([f"pad{k}"] if k % 2 else []) + ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", *extra]
        vocab = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int").cache()
        facts = wordpiece.vocab_ids(vocab)
        assert (facts["unk"], facts["size"], facts["maxlen"]) == (pieces.index("[UNK]"), len(pieces), max(map(len, pieces)))
        got = wordpiece.tokenize_words(spark.createDataFrame([(extra[0],), ("q",)], "w string"), vocab).collect()
        assert {r.w: r.ids for r in got} == {extra[0]: [len(pieces) - 1], "q": [pieces.index("[UNK]")]}
        vocab.unpersist()


def test_device_tokenizer(spark):
    pieces = {"play": 0, "pl": 1, "##ing": 2, "##in": 3, "##a": 4, "##y": 5, "##g": 6, "go": 7}
    f = lambda word, pieces: PieceTrie(pieces).device(word)
    assert f("play", pieces) == [0]
    # play + ing; then pl + a + y + in: after a hit the whole remainder is not tried, so the g is left out
    assert f("playing", pieces) == [0, 2, 1, 4, 5, 3]
    assert f("xyz", pieces) == []                              # dropped
    assert f("gog", pieces) == [7, 6]
    assert f("going", pieces) == [7, 2]
    vocab = spark.createDataFrame([(p, i) for p, i in pieces.items()], "piece string, id int")
    df = spark.createDataFrame([("play xyz going", "s"), (None, "s"), ("xyz", "t")], "text string, source string")
    got = {r.source: (r.n_words, r.n_ids, r.tokens_dropped) for r in wordpiece.device_rate(df, vocab, ids={"size": 8}).collect()}
    assert got == {"s": (3, 3, 1), "t": (1, 0, 1)}


def test_prompt_text(spark):
    """The prompt, spelled out: the oracle takes it from the same function."""
    text = dims.instruction(8)
    assert text.startswith("## Instruction: Classify the [MBTI] of the given [Text].\n        [Text]\n        know intj tool use ")
    assert text.endswith(" another freak realize\n        [MBTI]\n        intj\n        [Text]\n        ")


def test_truncated_rows_lose_their_target(spark):
    from tetrad.operators import batching
    df = spark.createDataFrame([(1, [5] * 3, [7, 8]), (2, [5] * 6, [7, 8]), (3, [5] * 5, [7, 8])], "post_id long, p array<long>, t array<long>")
    got = {r.post_id: (r.input_ids, r.labels, r.n_supervised) for r in batching.token_labels(df, "p", "t", max_length=6).collect()}
    assert got == {1: ([5, 5, 5, 7, 8], [-100] * 3 + [7, 8], 2), 2: ([5] * 6, [-100] * 6, 0), 3: ([5] * 5 + [7], [-100] * 5 + [7], 1)}
    b = batching.pad_batches(spark.createDataFrame([(1, [1, 2], [-100, 2]), (1, [3], [3])], "batch_id long, input_ids array<long>, labels array<long>"),
                             "input_ids", labels="labels")
    assert sorted((r.padded, r.padded_labels, r.mask) for r in b.collect()) == [([1, 2], [-100, 2], [True, True]), ([3, 0], [3, 0], [True, False])]


def test_vocabulary_in_two_files_is_refused(spark, tmp_dir):
    import pytest
    spark.range(4, numPartitions=2).selectExpr("cast(id as string) AS p").write.text(f"{tmp_dir}/two")
    with pytest.raises(ValueError):
        vocab_src.load_vocab_text(spark, f"{tmp_dir}/two")


def test_encode_posts_keeps_order_and_caps(spark):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "##b"]
    vocab = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int")
    posts = spark.createDataFrame([(1, "a b ab zz a"), (2, " ".join(["a"] * 600)), (3, "  "),
                                   (4, None)], "post_id long, posts string")
    got = {r.post_id: r.ids for r in wordpiece.encode_posts(posts, vocab).collect()}
    assert got[1] == [2, 4, 5, 4, 6, 1, 4, 3]
    assert got[3] == [2, 3] and got[4] == [2, 3]
    assert len(got[2]) == 512 and got[2][0] == 2 and got[2][-1] == 3


def test_vocab_export_load_round_trip(spark, tmp_dir):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "##s", "é"]
    v = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int")
    vocab_src.export_vocab_text(v, f"{tmp_dir}/vocab")
    back = vocab_src.load_vocab_text(spark, f"{tmp_dir}/vocab")
    assert sorted((r.piece, r.id) for r in back.collect()) == sorted(zip(pieces, range(len(pieces))))


def test_basic_tokens_like_java_regex(spark):
    text = "Hello, wörld! it's 3.5"
    got = spark.createDataFrame([(text,)], "t string").select(T.basic_tokens("t").alias("x")).first().x
    assert got == [m.group().lower() for m in re.finditer(r"\w+|\S", text, re.ASCII)]
