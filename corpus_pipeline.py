"""The corpus pipeline: documents through five operators, one stage each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tetrad.llm import exactdedup, jaccard, mixing, pieces, toxicity
from tetrad.llm.common import documents, labels
from tetrad.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty
    texts have no vote and stay; repeated rows and rows without id are judged
    by their own text."""
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that of the
    smallest id (none counts as the largest). Null and empty texts are one group."""
    return exactdedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, by op10's rule:
    that of the smallest id. Rows without id and texts without a word stay."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them. A null source is
    a source; texts without a word have size 0 and go the same way."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them; null
    and empty texts have no ids. A row per row."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing", mix_sources), ("SentencePiece", encode)]

#: a trained classifier and a tokenizer are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    base, docs = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
