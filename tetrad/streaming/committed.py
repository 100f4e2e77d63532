"""Results of micro-batches that a reader sees whole or not at all.

A batch is written to a folder of its own; a small file that names the folder
is put beside it by one rename when all is written. Readers follow these files
only, so a batch that was killed half way never shows, and a batch that is
replayed after its commit is left as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed_batches(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of every committed batch."""
    p, fs = _fs(spark, f"{path}/_commits")
    if not fs.exists(p):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    pairs = (n.split("_") for n in names if n.startswith("batch="))
    return {int(batch.removeprefix("batch=")): f"{path}/{folder}" for batch, folder in pairs}


def commit(spark: SparkSession, path: str, batch_id: int, folder: str) -> None:
    """Make ``folder`` the batch's result: an empty file whose name says so."""
    tmp, fs = _fs(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    fs.create(tmp, True).close()
    done, _ = _fs(spark, f"{path}/_commits/batch={batch_id}_{folder}")
    if not fs.rename(tmp, done):
        raise OSError(f"batch {batch_id} could not be committed")


def committed_sink(change: Callable[[DataFrame], DataFrame], path: str):
    """``foreachBatch`` function that writes ``change(batch)`` and commits it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed_batches(spark, path):
            return
        folder = f"{batch_id}-{uuid.uuid4().hex}"
        change(batch).write.parquet(f"{path}/{folder}")
        commit(spark, path, batch_id, folder)
    return run


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """All committed batches."""
    folders = committed_batches(spark, path)
    if not folders:
        raise FileNotFoundError(f"no committed batch in {path}")
    return spark.read.parquet(*[folders[b] for b in sorted(folders)])
