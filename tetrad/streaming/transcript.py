"""Stateful running transcript on a stream of utterances.

The reference appends every recognition result to one growing string and
re-classifies the whole text after each result; STOP clears it. Here the
stream is keyed by session (:mod:`tetrad.streaming.turns`): state holds the last
turn, the token count and the text as a list of pieces, so a trigger writes
what is new and not the text again; every new turn emits the transcript so far.

With ``max_tokens`` only the first N basic tokens are kept - the model never
sees more (R4) - so state per session is bounded. The N-th token is kept as
long as it may still grow: the text is full only when a character follows it.

Scoring (R2) is :mod:`tetrad.streaming.livescore`, which needs no text in state;
results go to :mod:`tetrad.streaming.committed`. The workers must have this
package (``spark-submit --py-files``).
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tetrad.functions.text import BASIC_TOKEN
from tetrad.streaming.turns import TurnProcessor, by_session

OUT_SCHEMA = "session_id long, turn long, late boolean, transcript string, n_tokens long"
_TOKEN = re.compile(BASIC_TOKEN, re.ASCII)
_WORD = re.compile(r"\w", re.ASCII)


def _count(text: str, n_tokens: int, add: str) -> int:
    """Basic tokens of text + add: a word that goes on counts once."""
    goes_on = bool(text and add and _WORD.match(text[-1]) and _WORD.match(add[0]))
    return n_tokens + sum(1 for _ in _TOKEN.finditer(add)) - goes_on


def _append(text: str, add: str, sep: str, n_tokens: int, full: bool, max_tokens: int | None):
    """(text, its tokens, whether it can take no more)."""
    if full:
        return text, n_tokens, True
    add = add if text == "" else sep + add
    if max_tokens is None:
        return text + add, _count(text, n_tokens, add), False
    new = text + add
    ends = [m.end() for m in _TOKEN.finditer(new)]
    if len(ends) < max_tokens:
        return new, len(ends), False
    end = ends[max_tokens - 1]
    closed = end < len(new) or not _WORD.match(new[end - 1])
    return new[:end], max_tokens, closed


class Transcript(TurnProcessor):
    """The text so far and its token count after every turn."""

    columns = ("transcript", "n_tokens")

    def __init__(self, sep: str = "", max_tokens: int | None = None, **kw):
        super().__init__(**kw)
        self.sep, self.max_tokens = sep, max_tokens

    def open_state(self, handle):
        self.head = handle.getValueState("head", "last_turn long, n_tokens long, full boolean", self.ttl_ms)
        self.pieces = handle.getListState("pieces", "text string", self.ttl_ms)

    def load(self) -> int:
        last, self.n, self.full = self.head.get() or (-1, 0, False)
        self.text = "".join(p[0] for p in self.pieces.get())
        self.stored = len(self.text)                 # a text only grows until a stop
        return last

    def stop(self):
        self.pieces.clear()
        self.text, self.n, self.full, self.stored = "", 0, False, 0

    def add(self, text):
        self.text, self.n, self.full = _append(self.text, text, self.sep, self.n, self.full, self.max_tokens)

    def values(self):
        return self.text, self.n

    def size(self):
        return len(self.text)

    def save(self, last):
        if self.ttl_ms is not None and self.text:    # every piece must live as long as the head
            self.pieces.put([(self.text,)])
        elif len(self.text) > self.stored:
            self.pieces.appendList([(self.text[self.stored:],)])
        self.head.update((last, self.n, self.full))


def running_transcript_stream(utterances: DataFrame, sep: str = "", max_tokens: int | None = None,
                              timeout_ms: int | None = None) -> DataFrame:
    """Streaming ``(session_id, turn, late, transcript, n_tokens)`` from a
    stream of ``(session_id, turn, text[, is_stop])``. One shuffle by session.
    Without ``max_tokens`` a task holds the longest session's text once."""
    return by_session(utterances, Transcript(sep, max_tokens, ttl_ms=timeout_ms), OUT_SCHEMA)


@contextmanager
def bounded_run(spark: SparkSession):
    """For ``availableNow`` runs: processing time makes the engine
    schedule state-cleanup batches forever, so no-data batches are switched
    off for queries started inside this block (the setting is captured when
    a query starts). Idle state then expires when new data arrives."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def read_utterances(spark: SparkSession, path: str, schema: str = "session_id long, turn long, text string",
                    files_per_trigger: int | None = None) -> DataFrame:
    """Any file source works; Parquet files dropped into ``path`` here."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)
