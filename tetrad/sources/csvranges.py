"""Records of CSV files with line breaks in quoted fields, read by many tasks.

Spark's multi-line CSV reader gives a whole file to one task, because a line
break may stand inside a quoted field and a task that begins in the middle of a
file cannot tell. Here the file's lines are read in ranges of
``spark.sql.files.maxPartitionBytes`` and the state is worked out:

1. each range says whether a quoted field is open at its end, for both cases:
   none was open at its beginning, or one was;
2. these small functions (one row a range) are composed from the beginning of
   each file, which gives the true state of every range;
3. each range then cuts its own records. A record that crosses ranges is put
   together from its pieces, at most two a range.

A field is quoted when its first character is the quote; a doubled quote stands
for one, and after the closing quote everything up to the delimiter belongs to
the field, as in Spark's own parser.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, DELIMITER = b'"', b","
_CLOSE = re.compile(rb'(?:[^"]++|"")*+"')
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def open_after(line: bytes, is_open: bool) -> bool:
    """Whether a quoted field is open after the line."""
    i = 0
    while True:
        if not is_open and line.startswith(QUOTE, i):
            is_open, i = True, i + 1
        if is_open:
            m = _CLOSE.match(line, i)
            if m is None:
                return True
            is_open, i = False, m.end()
        i = line.find(DELIMITER, i) + 1
        if not i:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines in order, with a hash of their file and the start of their range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").cast("long").alias("start"))


def _runs(batch: pa.RecordBatch):
    """(file, start, lines) of the batch's runs of lines of one range."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    cut = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]))).tolist()
    for a, b in zip(cut, [*cut[1:], len(file)]):
        for i in range(a, b, 4096):
            yield int(file[a]), int(start[a]), batch.column("line").slice(i, min(4096, b - i))


def _effects(batches):
    """A row per range: whether a field is open at its end, if none was at its beginning, and if one was."""
    at, ends = None, (False, True)
    for b in batches:
        for file, start, lines in _runs(b):
            if at != (file, start):
                if at:
                    yield _effect(at, ends)
                at, ends = (file, start), (False, True)
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                ends = tuple(open_after(line, e) for e in ends) if ends[0] != ends[1] else (open_after(line, ends[0]),) * 2
    if at:
        yield _effect(at, ends)


def _effect(at, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "closed": [ends[0]], "opened": [ends[1]]})


def open_ranges(lines: DataFrame) -> set[tuple[int, int]]:
    """The ranges that begin inside a quoted field. One row a range passes the
    driver: 800,000 rows for 100 TB in ranges of 128 MB."""
    effects = lines.mapInArrow(_effects, "file long, start long, closed boolean, opened boolean").toArrow() \
        .sort_by([("file", "ascending"), ("start", "ascending")])
    out, file, is_open = set(), None, False
    for f, start, closed, opened in zip(*(effects.column(c).to_pylist() for c in ("file", "start", "closed", "opened"))):
        if f != file:
            file, is_open = f, False
        if is_open:
            out.add((f, start))
        is_open = opened if is_open else closed
    return out


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(record)``: the text of every record of the files, without the header
    (the first record of each file) and without empty records."""
    lines = _lines(spark, path)
    begun = spark.sparkContext.broadcast(open_ranges(lines))

    def cut(batches, fragments: bool):
        """The records, or the pieces of those that cross ranges."""
        at, piece, is_open, from_before, first, out = None, [], False, False, False, []

        def put(kind: int) -> None:
            nonlocal piece, first, from_before
            text = b"\n".join(piece)
            if kind != WHOLE or text not in (b"", b"\r"):
                if (kind != WHOLE) == fragments and not (kind == WHOLE and first):
                    out.append((*at, kind, first and kind == TAIL, text))
                first = first and kind not in (WHOLE, TAIL)
            piece, from_before = [], False

        for b in batches:
            for file, start, run in _runs(b):
                if at != (file, start):
                    if piece:
                        put(MIDDLE if from_before else TAIL)
                    at, first = (file, start), header and start == 0
                    is_open = from_before = at in begun.value
                for line in run.to_pylist():
                    piece.append(line)
                    if QUOTE in line:
                        is_open = open_after(line, is_open)
                    if not is_open:
                        put(HEAD if from_before else WHOLE)
                if out:
                    yield _rows(out)
                    out = []
        if piece:
            put(MIDDLE if from_before else TAIL)
        if out:
            yield _rows(out)

    schema = "file long, start long, kind int, first boolean, text binary"
    whole = lines.mapInArrow(lambda it: cut(it, False), schema).select("text")
    pieces = lines.mapInArrow(lambda it: cut(it, True), schema)
    # a tail begins a record; the pieces after it, up to the next tail, continue it
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = pieces.withColumn("n", F.sum((F.col("kind") == TAIL).cast("long")).over(order)).groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "first", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"].cast("string")), "\n")
    joined = joined.filter(~F.element_at("p", 1)["first"]).select(text.alias("text"))
    return whole.select(F.col("text").cast("string").alias("record")).union(joined) \
        .select(F.regexp_replace("record", "\r$", "").alias("record"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    file, start, kind, first, text = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()),
                                       pa.array(first, pa.bool_()), pa.array(text, pa.binary())], ["file", "start", "kind", "first", "text"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None, header: bool = True) -> DataFrame:
    """Rows of headered CSV files by a schema; a record that does not fit goes
    whole to the column ``corrupt`` of the schema."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records(spark, path, header).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
