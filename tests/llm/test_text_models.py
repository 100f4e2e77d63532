"""Licence scan against brute force; language and toxicity by held-out accuracy."""

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from tetrad.llm import langid, licenses, toxicity
from tetrad.llm import words as W
from tetrad.llm.queries import QUERIES

SF_LARGE = "/root/testdata/sf0.1"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for label, phrase in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def key(i):
    return -1 if i is None else i


def check_base(rows, got):
    assert sorted((key(i), *map(str, base_of(t))) for i, t in rows) == sorted(
        (key(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0 or not r.labels)


def test_licences_of_documents(spark):
    for d in (SF_SMALL, SF_MID):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        got = QUERIES["op2_license_scan"](spark, d).collect()
        check_base(rows, got)
        by = {r.doc_id: r for r in got}
        assert all("gpl-3" in by[i].labels for i, t in rows if "GNU General Public License, version 3" in t)


def test_licences_of_hand_made_rows(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, None), (2, ""), (3, "under the MIT license"), (3, "under the MIT license"), (4, "under the mit"), (5, "license"),
            (6, "by NC, cc by-nc. CC BY NC by nc " * 3), (7, "é under\nthe MIT\tLicense; apache license version 2" * 2),
            (8, "x " * 50000 + "cc by nc"), (None, "cc by nc"), (9, mit), (10, mit.replace("charge", "cost")),
            (11, "under the mit licensed under the mit licensé"), (12, "ccbync cc_by_nc cc  by  nc")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, score int")
    got = licenses.scan_documents(df).collect()
    check_base(rows, got)
    by = {r.doc_id: r for r in got}
    assert by[9].labels == "mit" and by[9].score == 1 and by[10].labels == ""
    assert licenses.scan_documents(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=list("abAB é\n\t.0_\x0b\x1c漢"), max_size=30), max_size=8))
def test_words_of_batches(texts):
    import pyarrow as pa
    for sep, pattern in ((W.SPACE, r"[^\x20\x09-\x0D]+"), (W.NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashed = [], {}
        for i, j, data, offsets in W.slices(pa.array([*texts, None], pa.string()), 20):
            data = W.LOWER[data]
            starts, ends, doc = W.spans(data, offsets, sep)
            h = W.hashes(data, starts, ends)
            for s, e, d, x in zip(starts, ends, doc, h.tolist()):
                word = data[s:e].tobytes()
                got.append((i + d, word))
                assert hashed.setdefault(word, x) == x == W.hash_of(word)
        assert got == [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall(pattern, t.translate(LOWER))]
        assert len(set(hashed.values())) == len(hashed)


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def test_languages_of_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = QUERIES["op3_language_id"](spark, SF_MID).collect()
    assert len(got) == len(docs) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_languages_of_hand_made_rows(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("unbekannt", None)] * 12)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "fr"), (104, "½ ²³ 12", "en"), (105, "Ⅷ ①", "en"), (None, "the dog", None), (103, "die katze " * 20000, "de")]
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows], "doc_id long, text string, lang string, score double, p string")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {by[i].lang_pred for i in (100, 101, 102, 104, 105)} == {"und"} and by[100].score == 0
    assert (by[None].lang_pred, by[103].lang_pred) == ("en", "de")
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.filter("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = langid.identify(df.filter("lang is null or lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"und", "en"}


def test_toxicity_of_documents(spark):
    """Recall in every language and precision over all held-out labelled rows."""
    rows = spark.read.parquet(f"{SF_LARGE}/documents.parquet").select("doc_id", "lang").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_LARGE}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF_LARGE).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(r.lang, labels[r.doc_id], got[r.doc_id].predicted) for r in rows if got[r.doc_id].held_out and r.doc_id in labels]
    for lang in {x for x, toxic, _ in held if toxic}:
        found = [p for x, toxic, p in held if toxic and x == lang]
        assert sum(found) >= 0.9 * len(found), lang
    assert sum(toxic and p for _, toxic, p in held) >= 0.95 * sum(p for _, _, p in held)


def test_toxicity_of_hand_made_rows(spark):
    rows = [(1, None), (2, ""), (3, "a fine day"), (4, "you idiot, you moron"), (4, "you idiot, you moron"), (None, "scum"), (5, "x " * 50000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(1, 0, 1), (3, None, 0), (4, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, toxic int, text int")
    for have in (labels, labels.limit(0)):
        got = toxicity.score_documents(df, have).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r.score for r in got}
        assert by[1] == by[2] and by[4] > by[3]
        kept = toxicity.keep_clean(df, have)
        assert kept.columns == df.columns and kept.filter("doc_id = 3").count() == 1
    assert toxicity.score_documents(df.limit(0), labels).count() == 0


def test_label_model_finds_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    a = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05)
    votes = np.stack([a, a, np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.1), rng.random(4000) < 0.5], 1)
    label = np.where(rng.random(4000) < 0.05, 1 - y, y).astype(int)
    post, rho = toxicity.label_model(votes, label, np.ones(4000))
    assert rho[0, 1] > 0.9 > 0.3 > rho[0, 2]
    assert ((post > 0.5) == y).mean() > 0.93


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 5)), np.ones((200, 1))])
    y = np.where(x[:, 0] + 2 * x[:, 1] > 0.3, 1.0, -1.0)
    w = langid.fit_machine(x, y)
    assert (np.sign(x @ w) == y).mean() > 0.97


def test_sample_is_of_distinct_texts(spark):
    rows = [("en", f"plain words {i}") for i in range(400)] + [("de", f"deutsche worte {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    copies = spark.range(200_000).selectExpr("'de' lang", "'deutsche worte 0' text")
    drawn = {r.lang: r.n for r in langid._sample(df.union(copies)).groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()}
    assert drawn == {"en": langid.SAMPLE, "de": 200}
