"""Personal data by patterns and a skip-chain conditional random field.

The four patterns give the base spans. A conditional random field then labels
every word that holds a digit or an '@' (all others are outside any entity by
definition): a word's potentials come from its shape, its digits and the words
around it; neighbouring words share transition potentials; and words of a
document that repeat or resemble each other (same last digits, same address)
are tied to one hidden variable of the group, so that what one occurrence shows
counts for all others, however far away. Labels follow from loopy belief
propagation (sums over all labels, messages both ways, to a fixed point).
Runs of labelled words that overlap no base span are added to the base spans.

A group of n occurrences has n links, never pairs of occurrences.

The field is learned from the base spans of a bounded sample (``SAMPLE``
distinct texts, each of at most ``SAMPLE_CHARS`` characters, chosen by hash):
pseudo-likelihood, with mentions of the sample's entities repeated in a form
that the patterns miss, so that the ties are learned too. Every text is scored
whole.

Defined cases: null and empty texts have no spans. A corpus without base spans
adds none. Repeated rows are separate documents. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm.common import share
from tetrad.llm.words import slices
from tetrad.sources.tables import spread

KINDS = ("email", "ip", "card", "phone")
OUTSIDE, EMAIL, IP, CARD, PHONE = range(5)
LABELS = 5
#: texts that training draws, of those with and of those without an entity-like word, and their longest
SAMPLE, SAMPLE_CHARS = 600, 65_536
#: hashed features; least posterior of every word of an added span
DIM, LEAST = 1 << 13, 0.9
STEPS, RATE, RIDGE = 250, 0.2, 1e-4
ROUNDS, SETTLED = 20, 1e-5

# --- fixed values: the patterns of the base spans (written without backtracking where that changes nothing)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IPV4 = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# --- end of fixed values
LIKELY = r"@|\+[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){12}"

_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_BLANK = " \t\n\x0b\x0c\r"
_LEAD, _TRAIL = "!\"#$%&'*,-./:;<=>?[\\]^_`{|}~)", "!\"#$%&'*+,-./:;<=>?[\\]^_`{|}~("


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str):
    """An address is the run before an '@', back to the last address, and the
    domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start, domain = free + len(run.rstrip(LOCAL)), DOMAIN.match(text, at + 1)
        free = at + 1
        if start < at and domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the patterns' matches, by kind and start."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    out += [(IP, *m.span()) for m in IPV4.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((CARD, *m.span()))
    for m in CALL.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append((PHONE, *m.span()))
    return out


@dataclass
class Graph:
    """Words of texts: text number, span, features, the words each follows at
    once (``left``, -1: none), and the group that it is tied to (-1: none)."""
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    left: np.ndarray
    group: np.ndarray


def _hash(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % DIM


def _own(word: str) -> tuple[str, list[int], object]:
    """Shape, features and tie of one word."""
    digits = "".join(_DIGIT.findall(word))
    n = len(digits)
    shape = _LETTERS.sub("a", _DIGIT.sub("9", word[:64]))
    local, at, domain = word.partition("@")
    marks = "".join(sorted(set(_LETTERS.sub("a", _DIGIT.sub("9", word)))))[:16]
    dotted = word.split(".")
    ip = len(dotted) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in dotted)
    card = 13 <= n <= 19 and luhn(digits)
    f = [_hash("shape", shape), _hash("marks", marks), _hash("digits", min(n, 20), word[:1] == "+"), _hash("ip", ip, len(dotted) == 4),
         _hash("luhn", card, 13 <= n <= 19), _hash("at", bool(at), bool(local), "." in domain), _hash("first", shape[:2]), _hash("bias")]
    if at:
        tie = ("@", word.lower())
    elif n >= 7:
        tie = ("#", digits[-7:])
    else:
        tie = None
    return shape, f, tie


#: features of a word: its own, the word before, the shapes beside it
WIDTH = 11


def graph(texts: list[str]) -> Graph:
    rows, features, left, ties = [], [], [], []
    none = _hash("none")
    for k, text in enumerate(texts):
        seen: dict = {}
        end, shape = -9, None
        for m in _WORD.finditer(text):
            word = m.group()
            a = m.start() + len(word) - len(word.lstrip(_LEAD))
            b = m.end() - (len(word) - len(word.rstrip(_TRAIL)))
            if a >= b:
                continue
            near = 0 <= m.start() - end <= 2 and not text[end:m.start()].strip(_BLANK)
            before = shape
            shape, own, tie = _own(text[a:b])
            word_before = "" if near else text[max(0, m.start() - 24):m.start()].strip(_BLANK).rpartition(" ")[2].lower()[-12:]
            features.append([*own, _hash("before", word_before), _hash("left", before) if near else none, none])
            if near:
                features[-2][WIDTH - 1] = _hash("right", shape)
            left.append(len(rows) - 1 if near else -1)
            rows.append((k, a, b))
            ties.append(None if tie is None else seen.setdefault(tie, (k, len(seen))))
            end = m.end()
    count: dict = {}
    for t in ties:
        count[t] = count.get(t, 0) + 1
    number = {t: i for i, t in enumerate(t for t, n in count.items() if t is not None and n > 1)}
    at = np.array(rows, np.int64).reshape(-1, 3)
    return Graph(at[:, 0], at[:, 1], at[:, 2], np.array(features, np.int64).reshape(-1, WIDTH), np.array(left, np.int64),
                 np.array([number.get(t, -1) for t in ties], np.int64))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _level(m: np.ndarray) -> np.ndarray:
    return m - _logsum(m, 1)[:, None]


@dataclass
class Field:
    """Potentials: of features, of neighbours (left, right), of a tie by label."""
    words: np.ndarray
    pair: np.ndarray
    tie: np.ndarray

    def posteriors(self, g: Graph) -> np.ndarray:
        """Label probabilities of every word, by loopy belief propagation."""
        own = self.words[g.features].sum(1)
        n = len(own)
        to = np.flatnonzero(g.left >= 0)
        come, tied = g.left[to], np.flatnonzero(g.group >= 0)
        group = g.group[tied]
        from_left, from_right, from_tie = (np.zeros((n, LABELS)) for _ in range(3))
        agree = np.diag(self.tie)[None]
        for _ in range(ROUNDS):
            held = own + from_tie
            right = _level(_logsum((held + from_left)[come][:, :, None] + self.pair[None], 1))
            left = _level(_logsum((held + from_right)[to][:, None, :] + self.pair[None], 2))
            said = _level(_logsum((own + from_left + from_right)[tied][:, :, None] + agree, 1))
            total = np.zeros((int(group.max()) + 1 if len(group) else 0, LABELS))
            np.add.at(total, group, said)
            heard = _level(_logsum((total[group] - said)[:, None, :] + agree, 2))
            change = max((np.abs(a - b).max() for a, b in ((from_left[to], right), (from_right[come], left), (from_tie[tied], heard))
                          if len(b)), default=0.0)
            from_left[to], from_right[come], from_tie[tied] = right, left, heard
            if change < SETTLED:
                break
        return np.exp(_level(own + from_left + from_right + from_tie)) if n else np.zeros((0, LABELS))


def gold(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of every word: the first kind with a base span over part of it."""
    out = np.zeros(len(g.text), np.int64)
    for label in (PHONE, CARD, IP, EMAIL):
        for k, found in enumerate(spans):
            own = sorted((a, b) for x, a, b in found if x == label)
            if not own:
                continue
            lo, hi = np.searchsorted(g.text, [k, k + 1])
            starts, ends = np.array(own).T
            at = np.searchsorted(starts, g.end[lo:hi], "left") - 1
            inside = (at >= 0) & (ends[np.maximum(at, 0)] > g.start[lo:hi])
            out[lo:hi][inside] = label
    return out


def fit(g: Graph, label: np.ndarray) -> Field:
    """Pseudo-likelihood: each word's label given those of its neighbours and
    the label of most others of its group; Adam steps, a small ridge."""
    n = len(label)
    words, pair, tie = np.zeros((DIM, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    to = np.flatnonzero(g.left >= 0)
    come, tied = g.left[to], np.flatnonzero(g.group >= 0)
    other = np.zeros((n, LABELS))
    if len(tied):
        votes = np.zeros((int(g.group.max()) + 1, LABELS))
        np.add.at(votes, (g.group[tied], label[tied]), 1)
        rest = votes[g.group[tied]]
        rest[np.arange(len(tied)), label[tied]] -= 1
        other[tied, rest.argmax(1)] = 1
    right_of = np.eye(LABELS)[label]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (words, pair, tie)]
    flat = g.features.ravel()
    # entities are rare among the words: every label weighs as much as the square root of its words
    share_ = np.bincount(label, minlength=LABELS)
    weight = (1 / np.sqrt(np.maximum(share_, 1)))[label]
    weight *= n / weight.sum()
    for step in range(1, STEPS + 1):
        z = words[g.features].sum(1) + other * tie
        z[to] += pair[label[come]]
        z[come] += pair[:, label[to]].T
        d = (np.exp(_level(z)) - right_of) * (weight / n)[:, None]
        grad_words = np.stack([np.bincount(flat, np.repeat(d[:, k], WIDTH), DIM) for k in range(LABELS)], 1)
        grad_pair = np.zeros_like(pair)
        np.add.at(grad_pair, label[come], d[to])
        np.add.at(grad_pair.T, label[to], d[come])
        for p, grad, (m, v) in zip((words, pair, tie), (grad_words, grad_pair, (d * other).sum(0)), moments):
            grad = grad + RIDGE * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        np.maximum(tie, 0, out=tie)                       # a tie never speaks against agreement
    return Field(words, pair, tie)


def restated(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with mentions of its phones and cards added in a form that no
    pattern knows, and the spans of both."""
    parts, out, size = [text], list(spans), len(text)
    for label, a, b in spans:
        word = text[a:b]
        if label == PHONE and " " in word:
            again = word.partition(" ")[2].strip()         # without the country
        elif label == CARD:
            d = re.sub("[^0-9]", "", word)
            again = ".".join(d[i:i + 4] for i in range(0, len(d), 4))
        else:
            continue
        parts += [" and ", again, "\n"]
        out.append((label, size + 5, size + 5 + len(again)))
        size += 6 + len(again)
    return "".join(parts), out


def train(docs: DataFrame) -> Field | None:
    """The field of a corpus; None if the sample has no base span."""
    short = docs.select("text").filter(F.length("text") <= SAMPLE_CHARS)
    likely = F.col("text").rlike(LIKELY)
    parts = []
    for kind in (likely, F.col("text").rlike("[0-9@]") & ~likely):
        keys = short.filter(kind).select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        if keys is not None:
            parts.append(short.filter(kind & (F.xxhash64("text") <= keys)))
    texts = sorted({r.text for p in parts for r in p.distinct().limit(SAMPLE).collect()})
    known = [base_spans(t) for t in texts]
    if not any(known):
        return None
    texts, known = map(list, zip(*(restated(t, s) for t, s in zip(texts, known))))
    g = graph(texts)
    return fit(g, gold(g, known))


def _valid(label: int, word: str) -> bool:
    n = len(_DIGIT.findall(word))
    if label == EMAIL:
        return "@" in word.strip("@")
    if label == IP:
        return 4 <= n <= 12
    return 13 <= n <= 19 if label == CARD else 7 <= n <= 15


def added_spans(field: Field, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, float]]]:
    """(label, start, end, posterior) of the spans that the field adds."""
    out = [[] for _ in texts]
    g = graph(texts)
    p = field.posteriors(g)
    best = p.argmax(1)
    taken = gold(g, known) > 0
    sure = (best > 0) & (p.max(1, initial=0) >= LEAST) & ~taken
    at, k = np.flatnonzero(sure), 0
    while k < len(at):
        i, j = k, k + 1
        while j < len(at) and at[j] == at[j - 1] + 1 and g.left[at[j]] == at[j - 1] and best[at[j]] == best[at[i]] \
                and best[at[i]] in (CARD, PHONE):
            j += 1
        first, last, label = at[i], at[j - 1], int(best[at[i]])
        text, a, b = int(g.text[first]), int(g.start[first]), int(g.end[last])
        beside = (g.left[first] >= 0 and taken[g.left[first]]) or (last + 1 < len(taken) and g.left[last + 1] == last and taken[last + 1])
        if not beside and _valid(label, texts[text][a:b]):
            out[text].append((label, a, b, float(p[at[i:j], label].min())))
        k = j
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[x[0] - 1]}:{x[1]}:{x[2]}" for x in spans)


def spans_of(texts: list[str], field: Field | None):
    """Base and added spans of texts."""
    known = [base_spans(t) for t in texts]
    return known, added_spans(field, texts, known) if field else [[] for _ in texts]


def _texts(column: pa.Array):
    """Texts in runs of about a megabyte; a null is an empty text."""
    for i, j, _, _ in slices(column):
        yield [x or "" for x in column[i:j].to_pylist()]


def scanned(text: Column, field) -> Column:
    """Counts of base spans, their digest, and all spans; ``field``: a broadcast Field or None."""
    kinds = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(f"struct<{','.join(f'{k}:long' for k in kinds)},base_sha256:string,spans:string>")
    def run(column: pa.Array) -> pa.Array:
        counts, digests, spans = [], [], []
        for texts in _texts(column):
            for known, more in zip(*spans_of(texts, field.value)):
                counts.append([sum(x[0] == k for x in known) for k in range(1, LABELS)])
                base = _joined(known)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(_joined(sorted(known + [x[:3] for x in more])) if more else base)
        n = np.array(counts, np.int64).reshape(-1, len(KINDS))
        return pa.StructArray.from_arrays([*(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()),
                                           pa.array(spans, pa.string())], [*kinds, "base_sha256", "spans"])
    return run(text)


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, kind, start, end, text, base, score of every span."""
    held = share(docs.sparkSession, field)

    @F.arrow_udf("array<struct<kind:string,start:long,end:long,text:string,base:boolean,score:double>>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for texts in _texts(column):
            for t, known, more in zip(texts, *spans_of(texts, held.value)):
                rows = sorted([(*x, True, 1.0) for x in known] + [(*x[:3], False, x[3]) for x in more])
                out.append([{"kind": KINDS[x - 1], "start": a, "end": b, "text": t[a:b], "base": base, "score": s} for x, a, b, base, s in rows])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()),
                                                 ("base", pa.bool_()), ("score", pa.float64())])))
    return docs.select("doc_id", F.explode(run(F.col("text"))).alias("s")).select("doc_id", "s.*")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per document."""
    field = share(docs.sparkSession, train(docs))
    own = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return own.select("doc_id", scanned(F.col("text"), field).alias("s")).select("doc_id", "s.*")
