"""Language identification in two steps: family, then language.

Texts are count vectors of hashed byte n-grams (lower-cased, log counts, unit
length). The family is predicted first; within it, one-versus-one linear support
vector machines separate the languages. Families are duelled the same way.
Every duel is a row group of its own in Spark and is fitted on a bounded sample:
``SAMPLE`` distinct texts per language, drawn by text hash from the training
rows. The machines use the squared hinge loss, minimised by Newton steps over
the support vectors.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
are all texts when there is nothing to learn from. With one learned language
every other text gets it, with score 1. Null languages are not learned. Rows may
repeat. A null doc_id counts as the text ''. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import crc_mod, share
from tetrad.session import materialize

FOLDS, HELD_FOLD = 3, 1
SAMPLE = 300
FEATURES = 4096
GRAMS = (1, 2, 3, 4)
REGULAR = 0.02

# --- fixed values: families of languages by ISO code; any other code is a family of its own
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "austronesian": "id jv ms tl",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: one definition for training and prediction
LETTER = r"\p{L}"


def family(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], "=" + lang)


def vectors(texts: pa.Array):
    """(first row, end row, matrix) of hashed n-gram vectors, 256 texts at most
    at once; the last column is constant."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    for a in range(0, len(texts), 256):
        for i, j, data, offsets in W.slices(texts.slice(a, 256)):
            n = j - i
            counts = np.zeros(n * FEATURES)
            doc = np.repeat(np.arange(n), np.diff(offsets))
            key = np.zeros(len(data), np.uint64)
            for g in range(1, max(GRAMS) + 1):
                if len(data) < g:
                    break
                key = key[:len(data) - g + 1] * np.uint64(257) + data[g - 1:].astype(np.uint64) + np.uint64(1)
                if g in GRAMS:
                    own = doc[:len(key)]
                    inside = own == doc[g - 1:]
                    at = (W.mix(key) % np.uint64(FEATURES)).astype(np.int64)
                    counts += np.bincount((own * FEATURES + at)[inside], minlength=n * FEATURES)
            x = np.log1p(counts.reshape(n, FEATURES))
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.hstack([x / np.where(norm > 0, norm, 1), np.ones((n, 1))])
            yield a + i, a + j, x.astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss: Newton's method on
    the coefficients of the support vectors."""
    x = x.astype(np.float64)
    k = x @ x.T
    lam, beta = REGULAR * len(y) / 2, np.zeros(len(y))
    active = np.ones(len(y), bool)
    for _ in range(30):
        beta[:] = 0
        beta[active] = np.linalg.solve(k[np.ix_(active, active)] + lam * np.eye(int(active.sum())), y[active])
        now = y * (k @ beta) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return x.T @ beta


def _sample(training: DataFrame) -> DataFrame:
    """At most SAMPLE distinct texts per language, by text hash. The draw's rate
    is that of the distinct texts, so copies do not count."""
    rows = training.withColumn("h", F.xxhash64("text"))
    distinct = materialize(rows.select("lang", "h").distinct(), "lang-texts")
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy("h")
    drawn = distinct.join(F.broadcast(counts), "lang") \
        .filter((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) * F.col("n") <= 3 * SAMPLE) \
        .withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE).select("lang", "h")
    return rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")) \
        .select("lang", "text")


def train(training: DataFrame):
    """(duels, weights): a duel is (family or '', winner if positive, other);
    ``training``: (lang, text)."""
    rows = materialize(_sample(training), "lang-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    families = sorted({family(x) for x in langs})
    duels = [("", a, b) for i, a in enumerate(families) for b in families[i + 1:]]
    for f in families:
        own = [x for x in langs if family(x) == f]
        duels += [(f, a, b) for i, a in enumerate(own) for b in own[i + 1:]]
    if not duels:
        return langs, [], np.zeros((FEATURES + 1, 0), np.float32)
    side = [(x, k, y) for x in langs for k, (f, a, b) in enumerate(duels)
            for y, who in ((1.0, a), (-1.0, b)) if who == (x if f else family(x))]
    sides = rows.sparkSession.createDataFrame(side, "lang string, duel int, y double")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("text", "ascending"), ("y", "ascending")])
        parts = [x for _, _, x in vectors(t.column("text").combine_chunks())]
        w = fit_machine(np.vstack(parts), t.column("y").to_numpy())
        return pa.table({"duel": t.column("duel")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    # a family duel takes SAMPLE texts of each side
    w = Window.partitionBy("duel", "y").orderBy(F.xxhash64("text", F.lit(1)))
    each = rows.join(F.broadcast(sides), "lang").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE)
    fitted = each.select("duel", "y", "text").groupBy("duel").applyInArrow(fit, "duel int, w array<double>").collect()
    weights = np.zeros((FEATURES + 1, len(duels)), np.float32)
    for r in fitted:
        weights[:, r.duel] = r.w
    return langs, duels, weights


def _winner(duels, margins, group, names):
    """Index of the name that wins most duels of a group per row (ties by
    summed margins) and the confidence of its closest duel."""
    n = len(margins)
    wins, sums, low = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
    for k, (g, a, b) in enumerate(duels):
        if g == group:
            for who, m in ((names.index(a), margins[:, k]), (names.index(b), -margins[:, k])):
                wins[:, who] += m > 0
                sums[:, who] += m
                low[:, who] = np.minimum(low[:, who], m)
    best = np.argmax(wins + 0.5 * np.tanh(sums / max(1, len(names))), axis=1)
    with np.errstate(over="ignore"):
        return best, 1 / (1 + np.exp(-2 * low[np.arange(n), best]))


def predict(docs: DataFrame, model) -> DataFrame:
    """``docs`` with lang_pred and score from column ``text`` alone."""
    held = share(docs.sparkSession, model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        langs, duels, weights = held.value
        families = sorted({family(x) for x in langs})
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if langs:
            for i, j, x in vectors(texts):
                margins = (x @ weights).astype(np.float64)
                fam, conf = _winner(duels, margins, "", families)
                for f, name in enumerate(families):
                    own = [x for x in langs if family(x) == name]
                    rows = np.flatnonzero(fam == f)
                    if len(rows):
                        best, c = _winner(duels, margins[rows], name, own)
                        pred[i + rows] = np.array(own, object)[best]
                        score[i + rows] = conf[rows] * c
        return pa.StructArray.from_arrays([pa.array(pred.tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.withColumn("p", F.when(F.col("text").rlike(LETTER), run("text")).otherwise(none))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == HELD_FOLD).alias("held_out"),
                      "lang", "text")
    model = train(own.filter("not held_out and lang is not null").filter(F.col("text").rlike(LETTER)).select("lang", "text"))
    return predict(own.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "p.lang_pred", "p.score")
