"""Dataset variants on disk.

The reference writes two CSVs per variant (raw / balanced / proportional)
and picks one by flags. Here all variants go into one Parquet table
partitioned by ``variant`` and ``split``; choosing a dataset is a filter on
the partition columns, which the scan prunes to the matching folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_variants(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``(variant, split, ...)`` rows partitioned by variant and split.
    ``fmt='csv'`` writes headered CSV like the reference."""
    w = df.write.mode("overwrite").partitionBy("variant", "split")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    else:
        w.parquet(path)


def read_variant(spark: SparkSession, path: str, variant: str, split: str) -> DataFrame:
    """One dataset (variant, role): partition pruning reads only its folder."""
    return (spark.read.parquet(path)
            .where((F.col("variant") == variant) & (F.col("split") == split)))
