"""Evaluation metrics as plain aggregations.

Every metric is one global (or per-group) aggregate over per-row columns,
so Spark computes partial aggregates per task and merges them - the
reference's running counters, with ``all_reduce`` for free. Unlike the
reference, which reads only element 0 of each eval batch, every row counts.

Percentages are ``count / n * 100`` like the reference's prints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_KS = (3, 5, 10)


def letter_matches(answer: str | Column, gold: str | Column, n_letters: int = 4) -> Column:
    """Number of equal letters when the lengths agree, else null."""
    a = F.col(answer) if isinstance(answer, str) else answer
    g = F.col(gold) if isinstance(gold, str) else gold
    same = [(F.substring(a, i + 1, 1) == F.substring(g, i + 1, 1)).cast("int")
            for i in range(n_letters)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return F.when(F.length(a) == F.length(g), total)


def _pct(cond: Column) -> Column:
    return F.count_if(cond) / F.count(F.lit(1)) * 100


def classification_metrics(pred: DataFrame, groups: Sequence[str] = (), answer: str = "answer",
                           gold: str = "gold", gold_rank: str | None = "gold_rank",
                           n_letters: int = 4) -> DataFrame:
    """Accuracy, per-letter accuracy, mean letter match and Hit@k (A5, A6,
    A8, A9); one row per group. ``gold_rank`` = 1-based position of the gold
    class in the ranking (None for models without a ranking, A10)."""
    a, g = F.col(answer), F.col(gold)
    same_len = F.length(a) == F.length(g)
    m = letter_matches(answer, gold, n_letters)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.count_if(a == g).alias("correct"),
            F.round(_pct(a == g), 6).alias("accuracy"),
            F.round(F.sum(F.coalesce(m / float(n_letters), F.lit(0.0))) / F.count(F.lit(1)) * 100,
                    6).alias("mean_match")]
    for i in range(n_letters):
        aggs.append(F.round(_pct(same_len & (F.substring(a, i + 1, 1) == F.substring(g, i + 1, 1))),
                            6).alias(f"letter_{i}"))
    if gold_rank:
        for k in HIT_KS:
            aggs.append(F.round(_pct(F.col(gold_rank) <= k), 6).alias(f"hit_{k}"))
    return pred.groupBy(*groups).agg(*aggs)


def match_histogram(pred: DataFrame, answer: str = "answer", gold: str = "gold",
                    n_letters: int = 4) -> DataFrame:
    """Rows with exactly k letters right, k = 0..n (A7). The reference counts
    k = 1..n-1 and prints them as "k Wrong Rate"; named here by what is
    counted. ``(k, exactly_k_correct, rate)``."""
    m = letter_matches(answer, gold, n_letters)
    wide = pred.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(m == k).alias(f"_k{k}") for k in range(n_letters + 1)])
    stack = ", ".join(f"{k}, _k{k}" for k in range(n_letters + 1))
    return wide.selectExpr("_n", f"stack({n_letters + 1}, {stack}) AS (k, exactly_k_correct)") \
        .select("k", "exactly_k_correct",
                F.round(F.col("exactly_k_correct") / F.col("_n") * 100, 6).alias("rate"))


def generation_metrics(df: DataFrame, answer: str = "answer", naive: str = "naive",
                       gold: str = "gold") -> DataFrame:
    """Accuracy and mean letter match of the parsed answer and of the greedy
    next token (A11); a missing or wrong-length answer scores 0 letters."""
    g = F.col(gold)

    def mean_match(a: Column) -> Column:
        frac = F.when(F.length(a) == F.length(g), letter_matches(a, g) / F.length(g).cast("double"))
        return F.round(F.sum(F.coalesce(frac, F.lit(0.0))) / F.count(F.lit(1)) * 100, 6)

    a, nv = F.col(answer), F.col(naive)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.round(_pct(a == g), 6).alias("accuracy"),
                  mean_match(a).alias("mean_match"),
                  F.round(_pct(nv == g), 6).alias("naive_accuracy"),
                  mean_match(nv).alias("naive_mean_match"))


def epoch_loss(batch_losses: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Mean batch loss and perplexity exp(mean) per epoch."""
    return batch_losses.groupBy(epoch).agg(F.avg(loss).alias("_l")).select(
        epoch, F.round(F.col("_l"), 9).alias("loss"), F.round(F.exp("_l"), 9).alias("perplexity"))


def run_summary(epochs: DataFrame) -> DataFrame:
    """Averages over epochs (A15): perplexity and loss, plus epoch and
    checkpoint times when the log has them."""
    aggs = [F.round(F.avg("perplexity"), 9).alias("avg_train_prep"),
            F.round(F.avg("loss"), 9).alias("avg_train_loss"),
            F.count(F.lit(1)).alias("epochs")]
    for c, name in (("secs", "avg_epoch_time"), ("ckpt_secs", "avg_checkpoint_time")):
        if c in epochs.columns:
            aggs.append(F.round(F.avg(c), 9).alias(name))
    return epochs.agg(*aggs)
