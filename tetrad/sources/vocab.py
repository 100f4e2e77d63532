"""Vocabulary table: build, load from ``vocab.txt``, export.

A vocabulary maps a piece to its line number. It is small by nature (a
model's vocabulary, tens of thousands of pieces), which is what makes
reading it as one whole file and broadcasting it in joins safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import text as T

SPECIALS = [dims.PAD, dims.UNK, dims.CLS, dims.SEP]


def load_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    """``(piece, id)`` with id = line number from 0.

    ``spark.read.text`` splits a file across tasks and loses line order, so
    the file is read whole (one row) and exploded with positions. A folder of
    several files would give a line number twice and is refused."""
    whole = spark.read.text(path, wholetext=True)
    if whole.select(F.lit(1)).limit(2).count() > 1:
        raise ValueError(f"{path} holds more than one vocabulary file")
    lines = F.split(F.regexp_replace(F.col("value"), r"\n$", ""), "\n", -1)
    return whole.select(F.posexplode(lines).alias("id", "piece")).select(
        "piece", F.col("id").cast("int").alias("id"))


def export_vocab_text(vocab: DataFrame, path: str) -> None:
    """One piece per line in id order (S5). The vocabulary is small, so one
    output file is written by one task."""
    vocab.orderBy("id").select("piece").coalesce(1).write.mode("overwrite").text(path)


def build_vocab(docs: DataFrame | None, n_words: int, n_endings: int, text_col: str = "text",
                counts: DataFrame | None = None, always: Sequence[str] = ()) -> DataFrame:
    """Vocabulary of a corpus: the 4 special tokens, every character seen in
    a basic token, '##' + every such character, the ``n_words`` most frequent
    basic tokens longer than one character, '##' + the ``n_endings`` most
    frequent two-letter endings of tokens longer than two characters, and the
    basic tokens ``always`` (a prompt's own words). Ids
    follow (kind, piece); ties in frequency go to the smaller piece.

    The token counts are one aggregate with map-side combining (hot tokens
    collapse before the shuffle); the two top-k lists are bounded
    TakeOrderedAndProject steps. ``counts (w, n)`` may be given instead of
    ``docs`` when the token counts are already at hand.
    """
    if counts is None:
        tok = docs.select(F.explode(T.basic_tokens(text_col)).alias("t"))
        # read by five branches below; they share one aggregation shuffle
        counts = tok.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = counts.select(F.col("w").alias("t"), "n")
    spelled = counts.select("t")
    if always:
        spelled = spelled.union(counts.sparkSession.createDataFrame([(w,) for w in sorted(set(always))], "t string"))
    chars = (spelled.select(F.explode(F.split("t", "")).alias("piece")).distinct()
             .where(F.length("piece") == 1))
    words = (counts.where(F.length("t") > 1).orderBy(F.desc("n"), "t").limit(n_words)
             .select(F.col("t").alias("piece")))
    fixed = [(w,) for w in sorted(set(always)) if len(w) > 1]
    if fixed:
        words = words.union(counts.sparkSession.createDataFrame(fixed, "piece string")).distinct()
    endings = (counts.where(F.length("t") > 2)
               .groupBy(F.substring("t", -2, 2).alias("e")).agg(F.sum("n").alias("n"))
               .orderBy(F.desc("n"), "e").limit(n_endings)
               .select(F.concat(F.lit("##"), "e").alias("piece")))
    spark = counts.sparkSession
    specials = spark.createDataFrame([(i, s) for i, s in enumerate(SPECIALS)], "k int, piece string")
    allp = (specials.select(F.lit(0).alias("kind"), F.col("k"), "piece")
            .unionByName(chars.select(F.lit(1).alias("kind"), F.lit(0).alias("k"), "piece"))
            .unionByName(chars.select(F.lit(2).alias("kind"), F.lit(0).alias("k"),
                                      F.concat(F.lit("##"), "piece").alias("piece")))
            .unionByName(words.select(F.lit(3).alias("kind"), F.lit(0).alias("k"), "piece"))
            .unionByName(endings.select(F.lit(4).alias("kind"), F.lit(0).alias("k"), "piece")))
    # bounded table (specials + alphabet + n_words + n_endings): one ordered window
    w = Window.orderBy("kind", "k", "piece")
    return allp.select("piece", (F.row_number().over(w) - 1).cast("int").alias("id"))
