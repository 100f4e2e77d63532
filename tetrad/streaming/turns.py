"""Sessions as keyed state: rows of a trigger in turn order, in bounded memory.

``transformWithStateInPandas`` hands a session's new rows over as a stream of
frames in no order. ``TurnProcessor`` puts them in turn order without holding
them all: rows are gathered up to ``run_bytes``; what is more is sorted and laid
aside in map state as a run of blocks, and the runs are then merged, one block
of each in memory. The runs are gone when the trigger ends.

A turn at or below the last one seen came too late (or again): it changes
nothing and is emitted with ``late`` set. A stop row begins the session anew.
Subclasses keep their own state and say what a turn adds to it. With ``ttl_ms``
the state of a session expires when no row came for that long; otherwise it
stays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: text held before a run is laid aside, and text of one of its blocks (characters)
RUN_CHARS, BLOCK_CHARS = 1 << 23, 1 << 18
#: what a row counts for besides its text
ROW_CHARS = 64
#: characters after which output rows are handed on
OUT_CHARS = 1 << 21
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnProcessor(StatefulProcessor):
    """Base of the session processors. ``columns`` names what is emitted after
    session_id, turn and late."""

    columns: tuple[str, ...] = ()

    def __init__(self, ttl_ms: int | None = None, run_chars: int = RUN_CHARS, block_chars: int = BLOCK_CHARS):
        self.ttl_ms, self.run_chars, self.block_chars = ttl_ms, run_chars, block_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run int, block int",
                                       "turns array<long>, texts array<string>, stops array<boolean>")
        self.open_state(handle)

    # what a subclass does: open its state, load it (last turn first), clear it
    # at a stop, add a turn, save it, and give the values to emit
    def open_state(self, handle): raise NotImplementedError
    def load(self) -> int: raise NotImplementedError
    def stop(self) -> None: raise NotImplementedError
    def add(self, text: str) -> None: raise NotImplementedError
    def save(self, last: int) -> None: raise NotImplementedError
    def values(self) -> tuple: raise NotImplementedError
    def size(self) -> int: return 0

    def _lay_aside(self, rows: list, run: int) -> int:
        """A sorted run as blocks in state; how many."""
        block, chars, n = [], 0, 0
        for i, row in enumerate(rows):
            block.append(row)
            chars += ROW_CHARS + len(row[1] or "")
            if chars >= self.block_chars or i == len(rows) - 1:
                self.runs.updateValue((run, n), tuple(list(z) for z in zip(*block)))
                block, chars, n = [], 0, n + 1
        return n

    def _read_run(self, run: int, blocks: int) -> Iterator[tuple]:
        for b in range(blocks):
            turns, texts, stops = self.runs.getValue((run, b))
            self.runs.removeKey((run, b))
            yield from zip(turns, texts, stops)

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(turn, text, stop) of all frames by turn; equal turns as they came."""
        held, chars, blocks = [], 0, []
        for f in frames:
            texts = f["text"].where(f["text"].notna(), None)
            stops = f["is_stop"].fillna(False) if "is_stop" in f.columns else [False] * len(f)
            for turn, text, stop in zip(f["turn"], texts, stops):
                held.append((int(turn), text, bool(stop)))
                chars += ROW_CHARS + len(text or "")
                if chars >= self.run_chars:
                    held.sort(key=itemgetter(0))
                    blocks.append(self._lay_aside(held, len(blocks)))
                    held, chars = [], 0
        held.sort(key=itemgetter(0))
        if not blocks:
            return iter(held)
        return heapq.merge(*[self._read_run(i, n) for i, n in enumerate(blocks)], held, key=itemgetter(0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out, chars = self.load(), [], 0
        none = (None,) * len(self.columns)
        names = ["session_id", "turn", "late", *self.columns]
        for turn, text, stop in self.in_order(rows):
            if turn <= last:
                out.append((key[0], turn, True, *none))
            else:
                last = turn
                if stop:
                    self.stop()
                    continue
                if text is not None:
                    self.add(text)
                out.append((key[0], turn, False, *self.values()))
                chars += self.size()
            chars += ROW_CHARS
            if chars >= OUT_CHARS:
                yield pd.DataFrame(out, columns=names).astype({"turn": "int64"})
                out, chars = [], 0
        self.save(last)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"turn": "int64"})

    def close(self) -> None:
        pass


def by_session(utterances: DataFrame, processor: TurnProcessor, schema: str) -> DataFrame:
    """``processor`` over a stream of ``(session_id, turn, text[, is_stop])``:
    one shuffle by session. Rows without a turn have no place and are left out.
    State lives in RocksDB, so it may exceed memory; the session's provider is
    set for that when none was chosen."""
    use_rocksdb(utterances.sparkSession)
    keep = [c for c in ("session_id", "turn", "text", "is_stop") if c in utterances.columns]
    return utterances.select(*keep).where(F.col("turn").isNotNull()).groupBy("session_id") \
        .transformWithStateInPandas(processor, schema, "append", "None" if processor.ttl_ms is None else "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed list and map state needs the RocksDB store."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)
