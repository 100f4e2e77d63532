"""The variant store: texts once, datasets by joins of equal buckets."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tetrad.plans import fixtures as fx
from tetrad.sources import datasets, variants


def drawn(spark, n, keep):
    """Members: ids below n that keep says, every tenth for eval."""
    i = F.col("post_id")
    return spark.range(n).select(F.col("id").alias("post_id")).where(keep(i)).withColumn(
        "split", F.when(i % 10 == 9, "eval").otherwise("train"))


def posts(spark, n=400):
    return spark.range(n, numPartitions=3).select(F.col("id").alias("post_id"), F.concat(F.lit("text "), "id").alias("posts"))


def ids(df):
    return sorted(r.post_id for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_datasets_come_back_without_a_shuffle(spark, tmp_dir):
    store = variants.create_store(posts(spark), tmp_dir, bucket_ids=40)
    assert store.buckets == 10
    store.put("raw", drawn(spark, 400, lambda i: i >= 0))
    store.put("third", drawn(spark, 400, lambda i: i % 3 == 0))
    assert ids(store.read("third", "train")) == [i for i in range(0, 400, 3) if i % 10 != 9]
    eval_ = store.read("raw", "eval")
    assert ids(eval_) == list(range(9, 400, 10)) and eval_.columns == ["post_id", "posts"]
    plan = store.read("raw", "eval")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange" not in plan and "Sort " not in plan and plan.count("Bucketed: true") == 2
    assert "EqualTo(split,eval)" in plan


def test_one_file_a_bucket(spark, tmp_dir):
    store = variants.create_store(posts(spark), tmp_dir)
    store.put("raw", drawn(spark, 400, lambda i: i >= 0).repartition(13))
    for folder in ("posts", "members/raw"):
        assert len([f for f in os.listdir(f"{tmp_dir}/{folder}") if f.endswith(".parquet")]) <= store.buckets


def test_a_variant_is_replaced_alone(spark, tmp_dir):
    store = variants.create_store(posts(spark), tmp_dir)
    for v in ("a", "b"):
        store.put(v, drawn(spark, 400, lambda i: i < 100))
    before = sorted(os.listdir(f"{tmp_dir}/posts")), sorted(os.listdir(f"{tmp_dir}/members/b"))
    store.put("a", drawn(spark, 400, lambda i: i >= 390))
    assert ids(store.ids("a")) == list(range(390, 400)) and len(ids(store.ids("b"))) == 100
    assert before == (sorted(os.listdir(f"{tmp_dir}/posts")), sorted(os.listdir(f"{tmp_dir}/members/b")))
    store.put("a", drawn(spark, 400, lambda i: i < 0))           # empty: there, without rows
    assert ids(store.ids("a")) == [] and ids(store.read("a", "train")) == []


def test_a_store_is_opened_anew(spark, tmp_dir):
    store = variants.create_store(posts(spark), tmp_dir)
    store.put("a", drawn(spark, 400, lambda i: i < 100))
    store.detach()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.table(""))]
    again = variants.open_store(spark, tmp_dir)
    assert again == store and len(ids(again.read("a", "train"))) == 90
    again.put("b", drawn(spark, 400, lambda i: i < 20))
    assert len(ids(again.read("b", "train"))) == 18


def test_nulls_unknown_ids_and_empty_tables(spark, tmp_dir):
    rows = spark.createDataFrame([("x", None), ("y", "t"), (None, "u")], "key string, posts string")
    store = variants.create_store(rows, f"{tmp_dir}/a", id_col="key")
    store.put("v", spark.createDataFrame([("x", "train"), (None, "train"), ("z", "train")], "key string, split string"))
    assert [tuple(r) for r in store.read("v", "train").collect()] == [("x", None)]     # a null id is no member
    assert store.posts().count() == 3
    none = variants.create_store(posts(spark).limit(0), f"{tmp_dir}/b")
    none.put("v", drawn(spark, 5, lambda i: i >= 0))
    assert none.read("v", "train").count() == 0


def test_faults_are_refused(spark, tmp_dir):
    store = variants.create_store(posts(spark), tmp_dir)
    with pytest.raises(ValueError):
        variants.create_store(posts(spark), tmp_dir)
    with pytest.raises(ValueError):
        store.read("none", "train")
    with pytest.raises(ValueError):
        store.put("a/../b", drawn(spark, 5, lambda i: i >= 0))


def test_disk_is_that_of_the_texts(spark, tmp_dir):
    p = fx.posts(spark, SF_MID)
    p.repartition(8, "post_id").write.parquet(f"{tmp_dir}/once")
    store = variants.create_store(p, f"{tmp_dir}/store")
    for v in ("raw", "bal", "prop"):
        store.put(v, p.select("post_id", F.lit("train").alias("split")))
    assert size(f"{tmp_dir}/store") < 1.1 * size(f"{tmp_dir}/once")


def test_csv_files_of_a_variant(spark, tmp_dir):
    """The reference's form, for whoever wants the files themselves."""
    df = posts(spark, 20).withColumn("variant", F.lit("raw")).withColumn("split", F.lit("train"))
    datasets.write_variants(df, tmp_dir, "csv")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/variant=raw/split=train")
    assert sorted(int(r.post_id) for r in back.collect()) == list(range(20))
