"""Dataset variants as membership (S2, S3, U3): each text stored once.

The reference writes every variant out in full. Here a store has one table of
posts and, per variant, a table of ``(id, split)``. All are bucketed by id into
the same number of buckets, one file a bucket, so choosing a dataset joins a
bucket of ids with the same bucket of posts: no shuffle, no sort of texts, the
posts scanned once. A variant is drawn from ids and labels alone and replaced
without touching a text or another variant.

The tables are external ones of the session's catalog under names that follow
from the store's path; :func:`open_store` puts them there again in a new session.
A variant that is being replaced must not be read meanwhile. Posts without id
are kept in the table of posts and belong to no variant.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ids per bucket at which a bucket's ids fit a task's hash table many times over
BUCKET_IDS = 250_000
MIN_BUCKETS = 8


@dataclass(frozen=True)
class Store:
    """Where the tables lie, the id column and the number of buckets."""
    spark: SparkSession
    path: str
    id_col: str
    id_type: str
    buckets: int

    def table(self, name: str) -> str:
        return f"tetrad_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{name}"

    def _attach(self, name: str, folder: str, columns: str) -> str:
        """(Re)creates the catalog's entry of a table; its files stay."""
        table, place = self.table(name), f"{self.path}/{folder}".replace("'", r"\'")
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{self.id_col}`) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return table

    def _write(self, df: DataFrame, table: str) -> None:
        # the same hash as the buckets', so a task writes the file of one bucket
        df.repartition(self.buckets, self.id_col).write.insertInto(table, overwrite=True)

    def _members(self, variant: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_]+", variant):
            raise ValueError(f"a variant's name has letters, digits and _ only: {variant!r}")
        return self._attach(f"in_{variant}", f"members/{variant}", f"`{self.id_col}` {self.id_type}, split STRING")

    def exists(self, variant: str) -> bool:
        return _exists(self.spark, f"{self.path}/members/{variant}/_SUCCESS")

    def put(self, variant: str, members: DataFrame) -> None:
        """Writes, or replaces whole, a variant: ``members`` has the id, once
        each, and ``split``. Without rows the variant is there and empty."""
        own = members.select(self.id_col, "split").where(F.col(self.id_col).isNotNull())
        self._write(own, self._members(variant))

    def ids(self, variant: str, split: str | None = None) -> DataFrame:
        """``(id, split)`` of a variant, or of one of its splits."""
        if not self.exists(variant):
            raise ValueError(f"no variant {variant} in {self.path}")
        df = self.spark.table(self._members(variant))
        return df if split is None else df.where(F.col("split") == split)

    def posts(self) -> DataFrame:
        return self.spark.table(self.table("posts"))

    def read(self, variant: str, split: str) -> DataFrame:
        """The posts of one dataset (S3). A bucket's ids are the hash side, as
        they are bounded by the store's number of buckets; texts stream by."""
        ids = self.ids(variant, split).select(self.id_col)
        return self.posts().join(ids.hint("shuffle_hash"), self.id_col, "left_semi")

    def detach(self) -> None:
        """Takes the tables out of the session's catalog; their files stay."""
        prefix = self.table("")
        for t in self.spark.catalog.listTables(pattern=f"{prefix}*"):
            self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def create_store(posts: DataFrame, path: str, id_col: str = "post_id", bucket_ids: int = BUCKET_IDS) -> Store:
    """Lays the posts out in buckets by id, the only time that texts move. The
    number of buckets grows with the rows: ``bucket_ids`` a bucket."""
    spark, path = posts.sparkSession, path.rstrip("/")
    if _exists(spark, f"{path}/layout"):
        raise ValueError(f"there is a store in {path}")
    buckets = max(MIN_BUCKETS, -(-posts.select(id_col).count() // bucket_ids))
    store = Store(spark, path, id_col, dict(posts.dtypes)[id_col], buckets)
    store._write(posts, store._attach("posts", "posts", _columns(posts)))
    spark.createDataFrame([(id_col, store.id_type, buckets, _columns(posts))],
                          "id_col string, id_type string, buckets long, columns string") \
        .coalesce(1).write.parquet(f"{path}/layout")      # last: a store without it is not whole
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    """A store that is there, its posts put into this session's catalog."""
    path = path.rstrip("/")
    r = spark.read.parquet(f"{path}/layout").first()
    store = Store(spark, path, r.id_col, r.id_type, r.buckets)
    store._attach("posts", "posts", r.columns)
    return store
