"""Toxicity scores by weak supervision.

Many voters look at a text: a small fixed lexicon, word patterns, and lexicon
voters mined from the labelled training rows: a word, or all words with a given
beginning, that stands in many different contexts in toxic rows and makes up a
far larger share of their words than of the others'. Such a word may well occur
in clean texts too, so patterns also vote on how dense the hits are. A
generative model with one hidden label estimates, by EM, how often each voter
fires on either label (the given label is one more noisy voter, estimated like
the others), and the correlations between voters given the label; correlated
voters count less. A linear (logistic) classifier over the voters' counts and
densities is trained on the posterior labels and scores all texts.

Training uses a bounded sample: about ``SAMPLE`` labelled rows of each label,
drawn by a hash of the id, weighted back to the labels' true shares.

Defined cases: a null or empty text gets the score of a text without any vote.
A null label is no label; several labels of an id count as their largest.
With fewer than ``MIN_ROWS``
labelled rows of either label the fixed lexicon decides. Rows may repeat.
A null doc_id counts as the text ''. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import crc_mod, share
from tetrad.session import materialize

FOLDS, HELD_FOLD = 4, 2
#: labelled rows of either label that training draws
SAMPLE = {1: 3000, 0: 9000}
THRESHOLD = 0.3
#: of a mined voter: least number of different contexts in toxic rows, least ratio of its shares of the words of
#: toxic and of clean rows, and least log of that ratio times its contexts (14 nats: one unit in a million by chance)
MIN_CONTEXTS, MIN_RATIO, MIN_NATS = 5, 4.0, 14.0
#: mined voters that each toxic row of the sample should have
COVER = 3
#: lengths of word beginnings in bytes; 0 is the whole word
BEGINNINGS = (0, 4, 5, 6, 7)
#: labelled rows of either label without which the fixed voters decide
MIN_ROWS = 5
#: a voter's first rate, the given label's first accuracy, and the rows that this counts for
PRIOR_HIT, LABEL_ACCURACY, LABEL_ROWS = 0.05, 0.95, 100
#: mined hits in a hundred words above which a text is dense
DENSE = (0.25, 0.5, 1.0, 2.0, 4.0)

# --- fixed values: a small lexicon of insults
LEXICON = ["bastard", "bitch", "clown", "crap", "creep", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "hate",
           "idiot", "idiots", "imbecile", "jerk", "liar", "loser", "losers", "moron", "morons", "pathetic", "pig", "scum",
           "shit", "stupid", "trash", "ugly", "vermin", "worthless"]
PATTERNS = ["lexicon", "lexicon twice", "you and lexicon", "mined", "mined twice", "mined three times", "shouting", "many marks",
            *(f"mined above {x} %" for x in DENSE)]
RATES = ["lexicon hits", "mined hits"]


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Hash of each word (length 0) or of its beginning; and where there is one."""
    if not length:
        return W.hashes(data, starts, ends), np.ones(len(starts), bool)
    long = ends - starts > length
    return W.hashes(data, starts, np.where(long, starts + length, ends)) ^ W.U(length), long


def _read(data, offsets):
    low = W.LOWER[data]
    starts, ends, doc = W.spans(low, offsets, W.NON_ALNUM)
    return low, starts, ends, doc


class Voters:
    """The voters: hashes by kind of unit, mined ones after the lexicon."""

    def __init__(self, mined: list[tuple[int, int]]):
        """``mined``: (beginning length, hash)."""
        self.n = len(LEXICON) + len(mined)
        named = [(0, W.hash_of(w.encode()), k) for k, w in enumerate(LEXICON)] + \
                [(length, h, len(LEXICON) + k) for k, (length, h) in enumerate(mined)]
        self.kinds = {}
        for length in BEGINNINGS:
            own = sorted((h, k) for kind, h, k in named if kind == length)
            h = np.array([x for x, _ in own], np.uint64)
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
            self.kinds[length] = (h[first], first, np.array([k for _, k in own], np.int64))
        self.you = np.uint64(W.hash_of(b"you"))
        self.votes = self.n + len(PATTERNS)
        self.width = self.votes + len(RATES)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Hits of every voter per text (rows: texts), then the rates."""
        n = len(offsets) - 1
        low, starts, ends, doc = _read(data, offsets)
        out = np.zeros((n, self.width))
        hit = np.zeros((2, len(starts)), bool)           # by the lexicon, by a mined voter
        for length, (keys, first, voters) in self.kinds.items():
            if not len(keys):
                continue
            h, there = units(low, starts, ends, length)
            at, known = W.find(keys, h)
            known &= there
            rows = np.flatnonzero(known)
            if not len(rows):
                continue
            for k in range(len(keys)):
                own = rows[at[rows] == k]
                stop = first[k + 1] if k + 1 < len(first) else len(voters)
                for v in voters[first[k]:stop].tolist():
                    out[:, v] += np.bincount(doc[own], minlength=n)
                    hit[int(v >= len(LEXICON)), own] = True
        lex, mined = (np.bincount(doc[x], minlength=n) for x in hit)
        near = np.zeros(len(starts), bool)
        if lex.any():
            you = np.flatnonzero(W.hashes(low, starts, ends) == self.you)
            for step in (-3, -2, -1, 1, 2, 3):
                at = you + step
                at, me = at[(at >= 0) & (at < len(doc))], you[(at >= 0) & (at < len(doc))]
                near[me] |= hit[0, at] & (doc[at] == doc[me])
        words, sizes = np.maximum(np.bincount(doc, minlength=n), 1), np.diff(offsets)
        dense = 100 * mined / words
        mark = np.add.reduceat(np.append(data == 0x21, False).astype(np.int64), offsets[:-1]) * (sizes > 0) if n else 0
        upper = np.add.reduceat(np.append((data >= 0x41) & (data <= 0x5A), False).astype(np.int64), offsets[:-1]) * (sizes > 0) if n else 0
        patterns = [lex > 0, lex > 1, np.bincount(doc[near], minlength=n) > 0, mined > 0, mined > 1, mined > 2,
                    upper > 0.3 * np.maximum(sizes, 1), mark > 3, *(dense > x for x in DENSE)]
        out[:, self.n:self.votes] = np.stack(patterns, 1)
        out[:, self.votes:] = np.log1p(np.stack([100 * lex / words, dense], 1))
        return out


def mine(rows: DataFrame) -> list[tuple[int, int]]:
    """The mined voters. ``rows``: (text, toxic, row). A unit's support is the
    number of different words before it in toxic rows, so that copies count
    once; its ratio is that of its shares of all words of toxic and of clean
    rows. Those chosen cover every toxic row COVER times where they can, best
    first. What reaches the driver follows from the bounded sample."""
    def contexts(batches):
        for b in batches:
            for _, _, data, offsets in W.slices(b.column("text")):
                low, starts, ends, doc = _read(data, offsets)
                if not len(starts):
                    continue
                word = W.hashes(low, starts, ends)
                before = np.append(W.U(0), word[:-1])
                before[np.append(True, doc[1:] != doc[:-1])] = 0
                for length in BEGINNINGS:
                    h, there = units(low, starts, ends, length)
                    t, n = np.unique(np.stack([h[there], before[there]]), axis=1, return_counts=True)
                    yield pa.record_batch({"length": pa.array(np.full(t.shape[1], length, np.int32)), "h": pa.array(t[0].view(np.int64)),
                                           "before": pa.array(t[1].view(np.int64)), "n": pa.array(n, pa.int64())})

    toxic, clean = rows.filter("toxic = 1").select("text", "row"), rows.filter("toxic = 0").select("text")
    found = toxic.select("text").mapInArrow(contexts, "length int, h long, before long, n long") \
        .groupBy("length", "h", "before").agg(F.sum("n").alias("n")) \
        .groupBy("length", "h").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("pos")) \
        .filter(F.col("contexts") >= MIN_CONTEXTS).orderBy("length", "h").collect()
    if not found:
        return []
    among = share(rows.sparkSession, _Cover([(r.length, int(np.int64(r.h).view(np.uint64))) for r in found]))

    def others(batches):
        n = np.zeros(len(found) + 1, np.int64)            # and all words
        for b in batches:
            for _, _, data, offsets in W.slices(b.column("text")):
                among.value.add(n, data, offsets)
        k = np.flatnonzero(n)
        yield pa.record_batch({"k": pa.array(k), "n": pa.array(n[k])})

    def total(texts):
        n = np.zeros(len(found) + 1)
        for r in texts.select("text").mapInArrow(others, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            n[r.k] = r.n
        return n[:-1], max(1.0, n[-1])

    (pos, words), (neg, clean_words) = total(toxic), total(clean)
    support = np.array([r.contexts for r in found])
    ratio = (pos / words) / ((neg + 0.5) / clean_words)
    nats = support * np.log(np.maximum(ratio, 1e-9))
    good = np.flatnonzero((ratio >= MIN_RATIO) & (nats >= MIN_NATS))
    good = good[np.argsort(-nats[good], kind="stable")]   # best first
    if not len(good):
        return []
    cand = [(found[k].length, int(np.int64(found[k].h).view(np.uint64))) for k in good]
    probe = share(rows.sparkSession, _Cover(cand))

    def cover(batches):
        for b in batches:
            yield pa.record_batch({"row": b.column("row"), "hits": pa.array(
                [x for _, _, d, o in W.slices(b.column("text")) for x in probe.value.hits(d, o)], pa.list_(pa.int32()))})
    texts = toxic.mapInArrow(cover, "row long, hits array<int>").toArrow().sort_by("row").column("hits").combine_chunks()
    row, unit = pa.compute.list_parent_indices(texts).to_numpy(), texts.flatten().to_numpy()
    need, chosen = np.full(len(texts), COVER), []
    while True:                                           # set cover: the unit that most rows still need
        open_ = need[row] > 0
        gain = np.bincount(unit[open_], minlength=len(cand))
        gain[chosen] = 0
        best = int(np.argmax(gain))
        if not gain[best]:
            break
        chosen.append(best)
        need[row[unit == best]] -= 1
    return [cand[c] for c in chosen]


class _Cover:
    """Which of the mined candidates stand in a text."""

    def __init__(self, cand):
        self.kinds = {}
        for length in BEGINNINGS:
            own = sorted((h, k) for k, (kind, h) in enumerate(cand) if kind == length)
            self.kinds[length] = np.array([h for h, _ in own], np.uint64), np.array([k for _, k in own], np.int64)

    def add(self, n: np.ndarray, data, offsets) -> None:
        """Adds the occurrences of every candidate, and at the end the words."""
        low, starts, ends, _ = _read(data, offsets)
        n[-1] += len(starts)
        for length, (keys, number) in self.kinds.items():
            if len(keys) and len(starts):
                h, there = units(low, starts, ends, length)
                at, known = W.find(keys, h)
                np.add.at(n, number[at[known & there]], 1)

    def hits(self, data, offsets):
        low, starts, ends, doc = _read(data, offsets)
        out = [[] for _ in range(len(offsets) - 1)]
        for length, (keys, number) in self.kinds.items():
            if len(keys) and len(starts):
                h, there = units(low, starts, ends, length)
                at, known = W.find(keys, h)
                known &= there
                for d, k in np.unique(np.stack([doc[known], number[at[known]]]), axis=1).T.tolist():
                    out[d].append(k)
        return out


def label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 25):
    """Posterior of the hidden label per row, by EM over the voters' firing
    rates and the noisy given label; and the voters' correlations.

    Voters correlated given the label count less: each by one over one plus its
    summed correlations with the others.
    """
    v = votes.astype(np.float64)
    n, m = v.shape
    post = np.where(label == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    discount, rho = np.ones(m), np.zeros((m, m))
    prior = np.average(label, weights=weight) if n else 0.5
    given = (label == 1).astype(np.float64)
    for step in range(steps):
        rate = []
        for p in (1 - post, post):
            w = p * weight
            rate.append((w @ v + PRIOR_HIT) / (w.sum() + 1))
        prior = np.clip(np.average(post, weights=weight), 1e-4, 1 - 1e-4)
        if step == 5:                                     # labels have settled: correlations given the label
            cov, var = np.zeros((m, m)), np.zeros(m)
            for r, p in zip(rate, (1 - post, post)):
                w = (p * weight) / weight.sum()
                d = v - r
                cov += (d * w[:, None]).T @ d
                var += w @ (d * d)
            scale = np.sqrt(np.outer(var, var)) + 1e-12
            rho = np.clip(cov / scale, 0, 1) * (1 - np.eye(m))
            rho[rho < 0.1] = 0
            discount = 1 / (1 + rho.sum(1))
        fire = np.log(rate[1] / rate[0])
        silent = np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.log(prior / (1 - prior)) + v @ (discount * fire) + (1 - v) @ (discount * silent)
        # the given label: its rate of 1 on either hidden label
        said = []
        for p, first in ((1 - post, 1 - LABEL_ACCURACY), (post, LABEL_ACCURACY)):
            w = p * weight
            said.append((w @ given + LABEL_ROWS * first) / (w.sum() + LABEL_ROWS))
        logit += np.where(given == 1, np.log(said[1] / said[0]), np.log((1 - said[1]) / (1 - said[0])))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rho


def features(counts: np.ndarray, n: int) -> np.ndarray:
    """Classifier features: log counts of the voters, the patterns and rates, a constant."""
    return np.hstack([np.log1p(counts[:, :n]), counts[:, n:], np.ones((len(counts), 1))])


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the constant is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def score(self, data, offsets) -> np.ndarray:
        z = features(self.voters.counts(data, offsets), self.voters.n) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: (doc_id, text) that may be learned from; ``labels``: (doc_id, toxic)."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("toxic in (0, 1) and doc_id is not null").filter(crc_mod("doc_id", FOLDS) != HELD_FOLD) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = materialize(own, "toxic-labels")
    total = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share_of = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = {k: F.lit(SAMPLE[k] / max(1, total.get(k, 0))) for k in (0, 1)}
    most = F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])
    drawn = own.filter(share_of < most)
    rows = materialize(docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")
                       .dropDuplicates(["text", "toxic"]).withColumn("row", F.monotonically_increasing_id()), "toxic-sample")
    voters = Voters(mine(rows))
    held = share(spark, voters)

    def count(batches):
        for b in batches:
            c = [held.value.counts(d, o) for _, _, d, o in W.slices(b.column("text"))]
            c = np.vstack(c) if c else np.zeros((0, held.value.width))
            yield pa.record_batch({"toxic": b.column("toxic"), "row": b.column("row"),
                                   "c": pa.array(c.astype(np.float32).tolist(), pa.list_(pa.float32()))})
    t = rows.select("text", "toxic", "row").mapInArrow(count, "toxic int, row long, c array<float>").toArrow().sort_by("row")
    n = np.bincount(t.column("toxic").to_numpy(), minlength=2) if t.num_rows else np.zeros(2, int)
    if n.min() < MIN_ROWS:
        weights = np.zeros(voters.width + 1)              # nothing to learn from: the fixed voters decide
        weights[[voters.n, voters.n + 1]], weights[-1] = 2.0, -2.0
        return Model(voters, weights)
    counts = np.array(t.column("c").to_pylist())
    label = t.column("toxic").to_numpy()
    weight = np.array([total[k] / max(1, n[k]) for k in (0, 1)])[label]
    weight = weight / weight.mean()
    post, _ = label_model(counts[:, :voters.votes] > 0, label, weight)
    return Model(voters, fit_linear(features(counts, voters.n), post, weight))


def toxicity(text: Column, model) -> Column:
    """Score (0 to 1) of a text column; ``model``: a broadcast Model."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [model.value.score(d, o) for _, _, d, o in W.slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), "text")
    model = share(docs.sparkSession, train(own.filter("not held_out").select("doc_id", "text"), labels))
    return own.select("doc_id", "held_out", toxicity(F.col("text"), model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(crc_mod("doc_id", FOLDS) != HELD_FOLD)
    model = share(docs.sparkSession, train(own, labels))
    return docs.filter(toxicity(F.col("text"), model) < THRESHOLD)
