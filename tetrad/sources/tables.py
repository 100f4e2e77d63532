"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table ``<base>/<name>.parquet``. Column pruning and
    predicate pushdown are left to the optimizer: select only what you use."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a frame that is one input split (so at most
    ``spark.sql.files.maxPartitionBytes``) dealt to all cores; any larger
    input is returned as it is. For use after a narrow select, before costly
    per-row work."""
    if df.rdd.getNumPartitions() > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
