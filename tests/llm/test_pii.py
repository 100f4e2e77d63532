"""Base spans against the plain patterns; the field by held-out words and made cases."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tests.conftest import SF_MID, SF_SMALL
from tetrad.llm import pii as P
from tetrad.llm.queries import QUERIES

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def right(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text) if right(k, m.group())]


def named(spans):
    return [(P.KINDS[x[0] - 1], *x[1:3]) for x in spans]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()ab%é漢\n", max_size=60))
@example("a@b.c@d.e")
@example("@@a.b@-.c..d")
@example("1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255")
@example("+1 ((5 +12 3456789.")
@example("4111-1111 1111 1111-4111 1111")
def test_base_spans(text):
    assert named(P.base_spans(text)) == brute(text)


def test_long_runs_take_linear_time():
    for unit in ("a", "a@", "1", "1.", "+1 ", "+1(", "1 ", "a."):
        P.base_spans(unit * 200_000)
        P.graph([unit * 50_000])


def field():
    """A field of made texts."""
    texts = [f"words here call +1 ({100 + k}) 555-{1000 + 7 * k} or mail x.{k}@mail{k}.example.com from 10.{k}.0.{k} in 19{10 + k % 80}, "
             f"number {k * 37} of {k}.5 and {10 ** 15 + k * 9973}" for k in range(150)]
    texts, known = map(list, zip(*(P.restated(t, P.base_spans(t)) for t in texts)))
    g = P.graph(texts)
    return P.fit(g, P.gold(g, known))


FIELD = field()


def added(text, f=FIELD):
    return [(P.KINDS[x - 1], text[a:b]) for x, a, b, _ in P.added_spans(f, [text], [P.base_spans(text)])[0]]


def test_repeats_share_their_label():
    text = "call +1 (377) 555-0271 today. " + "plain words " * 400 + "then (377) 555-0271 again"
    assert added(text) == [("phone", "(377) 555-0271")]
    # the tie is what carries it: the same words, cut from the first mention, have less support
    g, alone = P.graph([text]), P.graph([text[60:]])
    assert FIELD.posteriors(g)[-1, P.PHONE] > FIELD.posteriors(alone)[-1, P.PHONE]
    assert FIELD.tie[P.PHONE] > 0


def test_clean_text_has_no_spans():
    text = "In 1999 the version 2.0 of part 17 had 3,500 users (see 4.2), 50% of 12-inch sizes; id 555 and a@ b."
    assert P.base_spans(text) == [] and added(text) == []


def test_messages_are_exact_on_a_chain_and_a_star():
    """Belief propagation on trees equals the sum over all labellings."""
    rng = np.random.default_rng(5)
    f = P.Field(rng.normal(size=(P.DIM, 5)) * 0.3, rng.normal(size=(5, 5)), rng.random(5))
    for text in ("11 22 33 44", "a@b z 5 y a@b w a@b"):
        g = P.graph([text])
        n, own = len(g.text), f.words[g.features].sum(1)
        total = np.zeros((n, 5))
        for y in itertools.product(range(5), repeat=n):
            e = sum(own[i, y[i]] for i in range(n)) + sum(f.pair[y[g.left[i]], y[i]] for i in range(n) if g.left[i] >= 0)
            w = np.exp(e)
            if (g.group >= 0).any():
                w *= sum(np.exp(sum(f.tie[h] * (y[i] == h) for i in range(n) if g.group[i] >= 0)) for h in range(5))
            for i in range(n):
                total[i, y[i]] += w
        assert np.allclose(f.posteriors(g), total / total.sum(1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op12_personal_data"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    extra = 0
    for r in out:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1]))
        extra += len(spans) - len(base)
    assert extra <= 0.02 * len(docs)


def test_held_out_words(spark):
    """Words of documents that training did not draw get the label of their base span."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").filter("text is not null")
    f = P.train(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1").collect()]
    g = P.graph(texts)
    label, got = P.gold(g, [P.base_spans(t) for t in texts]), f.posteriors(g).argmax(1)
    assert (got == label)[label > 0].mean() >= 0.95 and (got == label)[label == 0].mean() >= 0.95


def test_hostile_rows(spark):
    rows = [(1, None), (2, ""), (None, "mail a@b.cd"), (None, "mail a@b.cd"), (3, "x" * 300_000 + "@y.z"), (4, "+1 234 567 890 " * 3000),
            (5, "é漢 a.b@c.de 1.2.3.4")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_email int, spans string")
    out = P.scan_documents(df).collect()
    assert sorted((r.doc_id or -1, r.n_email, r.n_ip) for r in out) == sorted(
        (i or -1, *(sum(k == x for k, _, _ in brute(t or "")) for x in ("email", "ip"))) for i, t in rows)
    assert P.scan_documents(df.limit(0)).count() == 0
    assert all(r.spans == "" for r in P.scan_documents(df.filter("doc_id < 3")).collect())
    found = P.find(df.filter("doc_id = 5"), None).collect()
    assert [(r.kind, r.text, r.base) for r in found] == [("email", "a.b@c.de", True), ("ip", "1.2.3.4", True)]
