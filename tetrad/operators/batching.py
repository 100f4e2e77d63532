"""Fixed-size batches, dynamic padding, token labels.

The reference's loader walks the training file in order (file order is the
random permutation) and drops the last partial batch. Here the order is the
stored split key, so batch k holds the rows of rank k*B+1 .. (k+1)*B -
computed with the exact distributed rank (no global sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.functions import arrays as A
from tetrad.operators.rank import digits_for, exact_rank


def batches(ids: DataFrame, key: str, tie: str, batch_size: int, ratio: float = 1.0,
            digits: int | None = None) -> DataFrame:
    """Add ``batch_id`` and ``pos`` (0-based within the batch) over the first
    floor(n * ratio) rows in (key, tie) order, keeping only full batches
    (drop_last). Give it ids only; wide rows join the result by id (see
    :func:`with_batch`). The number of rank buckets follows the row count."""
    digits = digits or digits_for(ids.count())
    ranked = exact_rank(ids, key, tie, digits=digits, rank_col="_rank", total_col="_n")
    eligible = F.floor(F.col("_n").cast("double") * F.lit(float(ratio)))
    full = (eligible / batch_size).cast("long") * batch_size
    out = ranked.where(F.col("_rank") <= full)
    return (out.withColumn("batch_id", ((F.col("_rank") - 1) / batch_size).cast("long"))
            .withColumn("pos", ((F.col("_rank") - 1) % batch_size).cast("int"))
            .drop("_n", "_rank"))


def with_batch(rows: DataFrame, numbered: DataFrame, id_col: str = "post_id") -> DataFrame:
    """Wide rows with their ``batch_id`` and ``pos``: the narrow batch table
    is joined back by id."""
    return rows.join(numbered.select(id_col, "batch_id", "pos"), id_col)


def pad_batches(df: DataFrame, ids: str = "ids", batch: str = "batch_id",
                pad_id: int = 0, labels: str | None = None) -> DataFrame:
    """Right-pad every id array to the longest in its batch and add the
    attention mask (W4). With ``labels`` these arrays are padded to the same
    length, with the pad id too, as the reference's collator does. A batch
    is B rows, so the window is small."""
    w = Window.partitionBy(batch)
    out = df.withColumn("_len", F.max(F.size(ids)).over(w))
    if labels:
        out = out.withColumn("padded_labels", A.pad_to(F.col(labels).cast("array<bigint>"), F.col("_len"), pad_id))
    return (out.withColumn("padded", A.pad_to(F.col(ids).cast("array<bigint>"), F.col("_len"), pad_id))
            .withColumn("mask", A.attention_mask("padded", pad_id))
            .drop("_len"))


def token_labels(df: DataFrame, prompt_ids: str, target_ids: str, pad_id: int = 0,
                 max_length: int | None = None) -> DataFrame:
    """Next-token training rows (F6-F8): ``input_ids`` = prompt + target, cut
    at ``max_length`` like the reference's tokenizer call, ``labels`` = input
    ids with the prompt part set to -100, ``n_nonpad``, ``shifted`` =
    labels[1:], and ``n_supervised`` (0 flags a row whose target was cut
    off)."""
    inp = F.concat(F.col(prompt_ids).cast("array<bigint>"), F.col(target_ids).cast("array<bigint>"))
    if max_length is not None:
        inp = F.slice(inp, 1, max_length)
    out = df.withColumn("input_ids", inp)
    out = out.withColumn("labels", A.mask_prompt("input_ids", F.size(prompt_ids)))
    return (out.withColumn("n_nonpad", A.non_pad_length("input_ids", pad_id))
            .withColumn("shifted", A.shift_left("labels"))
            .withColumn("n_supervised", F.size(F.filter("labels", lambda x: x != -100))))
