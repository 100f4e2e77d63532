"""Scoring operators on the wide score form.

Scores are one ``ARRAY<DOUBLE>`` per row, so softmax, argmax, the full
ranking and top-k are per-row expressions: no shuffle, no window, and a
row with many classes never leaves its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.functions import arrays as A


def with_probs(df: DataFrame, logits: str = "z", out: str = "p") -> DataFrame:
    """Add the softmax of a logit array."""
    return df.withColumn(out, A.softmax(logits))


def long_probs(df: DataFrame, probs: str = "p", id_col: str = "post_id") -> DataFrame:
    """Wide -> long: ``(id, idx, p)``, 16 rows per input row."""
    return df.select(id_col, F.posexplode(probs).alias("idx", "p"))


def predictions(df: DataFrame, probs: str = "p", id_col: str = "post_id",
                gold: str = "gold") -> DataFrame:
    """``(id, gold, answer, answer_idx, confidence, ranking, gold_rank)``
    (T1, P3, S7): answer = best class (ties to the lower index),
    confidence = its probability, ranking = all class names best first."""
    rk = A.ranking_idx(probs)
    out = df.select(id_col, gold, probs, rk.alias("_rk"))
    names = F.transform(F.col("_rk"), A.idx_to_name)
    return out.select(
        id_col, gold,
        F.element_at("_rk", 1).alias("answer_idx"),
        A.idx_to_name(F.element_at("_rk", 1)).alias("answer"),
        F.element_at(F.col(probs), F.element_at("_rk", 1) + 1).alias("confidence"),
        names.alias("ranking"),
        F.array_position(names, F.col(gold)).alias("gold_rank"),
    )


def write_predictions(pred: DataFrame, path: str) -> None:
    """The predictions as a Parquet table (S7), in a new folder."""
    pred.write.mode("errorifexists").parquet(path)


def ranked_long(df: DataFrame, probs: str = "p", id_col: str | Sequence[str] = "post_id",
                k: int | None = None) -> DataFrame:
    """``(ids, rk, idx, name, p)`` best first; ``k`` keeps the top-k.
    ``id_col`` may be several columns, all of them kept. Ranking is a
    per-row ``array_sort``: no window, no shuffle (W2)."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rk = A.ranking_idx(probs)
    if k is not None:
        rk = F.slice(rk, 1, k)
    out = df.select(*ids, F.col(probs).alias("_p"), F.posexplode(rk).alias("_pos", "idx"))
    return out.select(*ids, (F.col("_pos") + 1).cast("long").alias("rk"), "idx",
                      A.idx_to_name(F.col("idx")).alias("name"),
                      F.element_at("_p", F.col("idx") + 1).alias("p"))


def top_k_string(ranking: str | Column, k: int = 10, sep: str = " ") -> Column:
    """The first k names of a ranking as one string (T4)."""
    r = F.col(ranking) if isinstance(ranking, str) else ranking
    return F.array_join(F.slice(r, 1, k), sep)


def compose_axes(df: DataFrame, p1: str = "p1") -> DataFrame:
    """Class from 4 two-way axis scores (M4): per axis the argmax of
    [1 - p1, p1] (a tie goes to 0), bits -> index -> name."""
    bits = [(F.element_at(F.col(p1), i + 1) > (1.0 - F.element_at(F.col(p1), i + 1))).cast("int")
            for i in range(4)]
    idx = A.bits_to_idx(*bits)
    return df.withColumn("answer_idx", idx) \
        .withColumn("bits", A.idx_to_bits(F.col("answer_idx"))) \
        .withColumn("answer", A.idx_to_name(F.col("answer_idx")))


def linear_head(df: DataFrame, weights: Sequence[Sequence[float]], vec: str = "embedding",
                out: str = "logits") -> DataFrame:
    """Logits = W . h with no bias (M5). ``weights`` is the model's
    (classes x dim) matrix - bounded by the model size, so it is a literal
    in the plan rather than a join; each row is scored in place."""
    h = F.col(vec)
    rows = [F.aggregate(F.zip_with(h, F.array(*[F.lit(float(x)) for x in w]),
                                   lambda a, b: a.cast("double") * b),
                        F.lit(0.0).cast("double"), lambda acc, x: acc + x)
            for w in weights]
    return df.withColumn(out, F.array(*rows))
