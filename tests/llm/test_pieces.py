"""Encoding, decoding and counts against the tokenizer libraries."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tetrad.llm import pieces, tokencount

SP = SentencePieceProcessor(model_file=pieces.model_path())
CASES = ["", " ", "  ", "\n", "a", " a", "a ", "  a  b   c ", "\n\na\n b", "▁", "▁▁ a▁b", "<s> </s> <unk> <0x41>",
         "é́ ü 漢字 😀👍🏽 ​\x00\x7f", "\t\x0b\x0c\r", "aaaa" * 50, " " * 100, "x" * 3000, "1234567890" * 20,
         "Hello world. This is it!\nNext line", "Ã­" * 7, "퟿￿\U0010ffff"]


def check(text):
    t = pieces.table(pieces.model_path())
    ids = SP.encode(text)
    assert t.encode(text) == ids
    assert t.decode(ids) == SP.decode(ids)
    n, joined, decoded = t.digests(text)
    assert (n, joined.decode(), decoded.decode()) == (len(ids), ",".join(map(str, ids)), SP.decode(ids))
    assert tokencount.counter(pieces.model_path()).count([text]) == [len(ids)]


@pytest.mark.parametrize("text", CASES)
def test_same_as_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t▁.,aeiotnshrldé!1290<>x")), st.characters(exclude_categories=["Cs"]))))
def test_same_as_library_on_any_text(text):
    check(text)


def test_documents(spark):
    from tests.conftest import SF_SMALL
    from tetrad.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = QUERIES["op4_sentencepiece"](spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = SP.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))
    out = QUERIES["op6_token_counts"](spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(SP.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


ROWS = [(1, None), (2, ""), (3, "same text"), (4, "same text"), (4, "same text"), (None, "same text"), (None, None),
        (5, "w " * 60000)]


def test_nulls_empty_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, content string, n int")
    want = sorted((i if i is not None else -1, len(SP.encode(t or ""))) for i, t in ROWS)
    got = pieces.encode_documents(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == want
    got = tokencount.count_tokens(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == want
    assert pieces.encode_documents(df.limit(0)).count() == 0
    assert tokencount.count_tokens(df.limit(0)).count() == 0
    ids = df.select(pieces.piece_ids(df.text).alias("i"))
    assert sorted(len(r.i) for r in ids.collect()) == sorted(n for _, n in want)
    back = ids.select(pieces.piece_text(ids.i).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(SP.decode(SP.encode(t or "")) for _, t in ROWS)


def test_cache_is_reused(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b")], "doc_id long, text string")
    tokencount.count_tokens(df, cache_path=tmp_dir).collect()
    first = spark.read.parquet(tmp_dir).count()
    more = df.union(spark.createDataFrame([(9, "new one")], df.schema))
    assert tokencount.count_tokens(more, cache_path=tmp_dir).count() == 4
    assert (first, spark.read.parquet(tmp_dir).count()) == (2, 3)


def test_json_tokenizer(spark):
    from tokenizers import Tokenizer
    path = pieces.model_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, "Hello <|endoftext|> there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()}
    assert got == {1: len(t.encode("Hello <|endoftext|> there", add_special_tokens=False).ids), 2: 0}


def test_tables_are_bounded_by_bytes():
    recent = pieces.Recent(10_000)
    for k in range(5_000):
        recent.put(f"part {k}", "1,2,3" * (k % 50))
        assert recent.bytes <= 10_000
    assert recent.get("part 4999") is not None and recent.get("part 0") is None
    t = pieces.table(pieces.model_path())
    long = "a" * (pieces.LONGEST_KEPT + 1)
    assert t.encode(long) == SP.encode(long) and "▁" + long not in t.known.new


def test_other_models_are_refused():
    class Fake:
        """A model whose scores are log probabilities."""
        get_piece_size = lambda self: 3
        is_control = is_unknown = is_byte = lambda self, i: False
        get_score = lambda self, i: -1.5 * i
        normalize = lambda self, text: text.lower()

    with pytest.raises(ValueError, match="no BPE"):
        pieces._check(Fake(), "fake")
    Fake.get_score = lambda self, i: -float(i)
    with pytest.raises(ValueError, match="changes texts"):
        pieces._check(Fake(), "fake")
