"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "tetrad",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    On a cluster, pass ``master=None`` and let spark-submit decide: only AQE,
    skew-join handling and the UTC time zone are set, and the cluster's own
    ``spark.checkpoint.dir`` is kept. Locally (tests, bench) the UI is off
    and a scratch checkpoint folder is set when none is configured.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.ui.enabled"] = conf["spark.ui.showConsoleProgress"] = "false"
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("TETRAD_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from the cluster's ``spark.checkpoint.dir`` (or a directory
    already set on the context). Only when neither exists and the master is
    local (tests) a fresh scratch folder is created and registered; a cluster
    without a shared folder is an error, as executors cannot see each
    other's local disks.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        cur = sc.getCheckpointDir()
        # getCheckpointDir() appends a per-application uuid folder
        d = os.path.dirname(cur.rstrip("/")) if cur else None
    if not d and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="tetrad-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}"


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when no
    frame that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "").rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "t"):
    """Write ``df`` once as Parquet into the shared checkpoint folder and
    read it back: cuts the lineage (survives executor loss, unlike a cache)
    and computes the plan once - ``DataFrame.checkpoint()`` runs it twice
    unless persisted first. The read-back table has exact size statistics,
    so the planner can decide broadcasts on real sizes."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
