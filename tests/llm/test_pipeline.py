"""The pipeline's stages and the registration of its queries."""

import hashlib

from sentencepiece import SentencePieceProcessor

import __spark_entry__
import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard import brute
from tetrad.llm import mixing, pieces, toxicity
from tetrad.llm.common import documents, labels


def test_stages(spark):
    docs = documents(spark, SF_SMALL)
    score = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels(spark, SF_SMALL)).collect()}
    rows = [r for r in docs.collect() if not score[r.doc_id]]
    assert len(rows) < docs.count()
    best = {}
    for r in rows:
        norm = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[norm] = min(best.get(norm, r), r, key=lambda x: (-len(x.text), x.doc_id))
    rows = list(best.values())
    roots = {w for w in brute([(r.doc_id, r.text) for r in rows])}
    keep = {int(w.strip("()").split(", ")[0]) for w in roots if w.strip("()").split(", ")[0] == w.strip("()").split(", ")[2]}
    rows = [r for r in rows if r.doc_id in keep]
    left = spark.createDataFrame(rows, docs.schema)
    want = {r.doc_id: r.copies for r in mixing.mix_report(left).collect()}
    sp = SentencePieceProcessor(model_file=pieces.model_path())
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    text = {r.doc_id: r.text for r in rows}
    for r in out:
        ids = sp.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_stages_on_hand_made_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (None, "x y", None, "b"), (3, "x  y", None, None),
            (4, "z " * 50000, "de", "b"), (5, "you idiot", "en", "b")]
    df = spark.createDataFrame([(*r, 1, "row") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    left = {"toxicity": [1, 1, 2, 3, 4, None], "exact dedup": [1, 3, 4], "n-gram Jaccard join": [1, 3, 4]}
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        if name in left:                                  # empty texts are equal: one stays, of the smallest id; 'x  y' is longer than 'x y'
            assert sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i)) == left[name], name
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == df.columns
    got = [r.doc_id for r in docs.collect()]             # each source is repeated 3 times at most
    assert {4} <= set(got) <= {1, 3, 4} and all(got.count(i) <= 3 for i in got)
    docs = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
