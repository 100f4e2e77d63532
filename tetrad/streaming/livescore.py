"""Scores of a growing text, kept up turn by turn (R2).

The reference classifies the whole text again after every result. A linear
model over words needs only the new ones: a session's state is its sum of
weights per class over closed words, and the last word while it may still grow
(texts are joined without a blank by default, so ``hel`` and ``lo`` are one word).
A turn costs its own words, however long the text before it is.

Weights are whole numbers (see ``model.fit_buckets``): the sums are exact, equal
to those of the whole text in any order. The matrix has one row per word bucket, a fixed
size; it travels with the processor (a quarter of a megabyte), as the process
that opens the state on the driver has no broadcasts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.functions import arrays as A
from tetrad.functions.text import BASIC_TOKEN
from tetrad.operators import model as M
from tetrad.streaming.turns import TurnProcessor, by_session

OUT_SCHEMA = "session_id long, turn long, late boolean, scores array<long>, n_tokens long"
#: bytes of weights that may travel with the processor
MODEL_BYTES = 1 << 19
_TOKEN = re.compile(BASIC_TOKEN, re.ASCII)
_WORD = re.compile(r"\w", re.ASCII)


class LiveScore(TurnProcessor):
    """Class scores of the text so far after every turn."""

    columns = ("scores", "n_tokens")

    def __init__(self, weights, prior, digits: int, sep: str = "", max_tokens: int | None = None, **kw):
        """``weights``: a matrix (16**digits, classes)."""
        super().__init__(**kw)
        self.weights, self.prior, self.digits = weights, prior, digits
        self.sep, self.max_tokens = sep, max_tokens

    def open_state(self, handle):
        # sums over closed words, their number, the word that may still grow,
        # whether any text came, whether max_tokens closed words are in
        self.head = handle.getValueState(
            "head", "last_turn long, sums array<long>, n long, tail string, begun boolean, full boolean", self.ttl_ms)

    def load(self) -> int:
        got = self.head.get()
        if got is None:
            self.stop()
            return -1
        last, sums, self.n, self.tail, self.begun, self.full = got
        self.sums = np.array(sums, np.int64)
        return last

    def stop(self):
        self.sums = np.zeros(len(self.prior), np.int64)
        self.n, self.tail, self.begun, self.full = 0, "", False, False

    def _row(self, word: str) -> np.ndarray:
        return self.weights[int(hashlib.md5(word.lower().encode()).hexdigest()[:self.digits], 16)]

    def add(self, text):
        if self.full or not text:
            return
        body = self.tail + (self.sep if self.begun else "") + text
        self.begun, self.tail = True, ""
        for m in _TOKEN.finditer(body):
            if m.end() == len(body) and _WORD.match(body[-1]):
                self.tail = m.group()                # open: the next turn may go on with it
                break
            self.sums = self.sums + self._row(m.group())
            self.n += 1
            if self.n == self.max_tokens:
                self.full = True
                break

    def values(self):
        z = self.sums + self.prior
        if self.tail:
            z = z + self._row(self.tail)
        return z.tolist(), self.n + bool(self.tail)

    def size(self):
        return 16 * len(self.prior)

    def save(self, last):
        self.head.update((last, self.sums.tolist(), self.n, self.tail, self.begun, self.full))


def live_scores(utterances: DataFrame, fitted: M.BucketModel, sep: str = "", max_tokens: int | None = None,
                timeout_ms: int | None = None) -> DataFrame:
    """Streaming ``(session_id, turn, late, scores, n_tokens, p)``: the scores of
    the text so far (``scores`` are ``model.SCALE``-fold log values) and their
    softmax. One shuffle by session."""
    if fitted.weights.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {fitted.weights.nbytes} bytes; {MODEL_BYTES} at most (fewer digits)")
    out = by_session(utterances, LiveScore(*fitted, sep, max_tokens, ttl_ms=timeout_ms), OUT_SCHEMA)
    return out.withColumn("p", A.softmax(F.transform("scores", lambda s: s / F.lit(float(M.SCALE)))))
