"""WordPiece as a corpus job.

Greedy longest-match-first: from the start of a word, take the longest
prefix in the vocabulary, continue after it with '##'-pieces; when some
position has no match the whole word becomes [UNK]. A caller may also make
words longer than ``max_chars`` [UNK], as library tokenizers do.

The vocabulary goes to the workers as a trie (its counted size is checked), and
a word is tokenized in one pass over its characters (:mod:`.piecetrie`), so the
longest word is as cheap per character as any other. Corpus statistics tokenize
each *distinct* word once, after the aggregate by word; texts are encoded where
they are, row by row, without any shuffle: their basic tokens come from the
JVM, their ids from the trie, and frequent words are remembered in a bounded
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import text as T
from tetrad.operators.piecetrie import PieceTrie

# largest vocabulary that goes to the workers
VOCAB_BROADCAST_MAX = 2_000_000
#: words that a task remembers, and their longest
WORDS_KEPT, LONGEST_KEPT = 100_000, 32


def vocab_ids(vocab: DataFrame) -> dict:
    """Ids of the special tokens, the longest piece length and the size: one
    small aggregate over the vocabulary. The functions below take the result
    as ``ids`` so that a caller computes it once per vocabulary."""
    row = vocab.agg(
        *[F.max(F.when(F.col("piece") == s, F.col("id"))).alias(n)
          for n, s in (("pad", dims.PAD), ("unk", dims.UNK), ("cls", dims.CLS), ("sep", dims.SEP))],
        F.max(F.length(F.regexp_replace("piece", "^##", ""))).alias("maxlen"),
        F.count(F.lit(1)).alias("size")).first()
    return row.asDict()


def word_counts(docs: DataFrame, text_col: str = "text", groups: tuple = ()) -> DataFrame:
    """``(groups, w, n)``: basic-token frequencies."""
    raw = F.regexp_extract_all(F.col(text_col), F.lit(T.BASIC_TOKEN), 0)
    tok = docs.select(*groups, F.explode(raw).alias("w")).select(*groups, F.lower("w").alias("w"))
    return tok.groupBy(*groups, "w").agg(F.count(F.lit(1)).alias("n"))


def piece_trie(vocab: DataFrame, ids: dict | None = None) -> PieceTrie:
    """The vocabulary as a trie on the driver, its size checked before."""
    ids = ids or vocab_ids(vocab)
    if int(ids["size"]) > VOCAB_BROADCAST_MAX:
        raise ValueError(f"a vocabulary of {ids['size']} pieces is too large for the workers")
    return PieceTrie({r.piece: int(r.id) for r in vocab.select("piece", "id").collect()}, ids.get("unk"))


def tokenize_words(words: DataFrame, vocab: DataFrame, word_col: str = "w",
                   max_chars: int | None = None, ids: dict | None = None,
                   carry: tuple = ()) -> DataFrame:
    """``(w, carry..., ids ARRAY<INT>, unk BOOLEAN)`` for distinct words
    (distinct on ``(w, carry...)``; ``carry`` columns such as a count ride
    along, so no join back is needed). A narrow map: no join, no shuffle."""
    ids = ids or vocab_ids(vocab)
    trie = words.sparkSession.sparkContext.broadcast(piece_trie(vocab, ids))
    unk = int(ids["unk"])

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        greedy = trie.value.greedy
        return pa.array([[unk] if max_chars is not None and len(w) > max_chars else greedy(w) for w in col.to_pylist()],
                        pa.list_(pa.int32()))
    out = words.select(F.col(word_col).alias("w"), *carry).where(F.col("w").isNotNull()).withColumn("ids", run("w"))
    return out.withColumn("unk", (F.size("ids") == 1) & (F.element_at("ids", 1) == unk))


def encoded(tokens: Column, trie, limit: int | None) -> Column:
    """Ids of an array of basic tokens, at most ``limit``; ``trie``: a broadcast
    :class:`PieceTrie`. A null array gives none."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        greedy, known = trie.value.greedy, {}

        def of(w: str) -> list[int]:
            out = known.get(w)
            if out is None:
                out = greedy(w)
                if len(w) <= LONGEST_KEPT:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    known[w] = out
            return out

        for rows in batches:
            offsets, values = [0], []
            for i in range(0, len(rows), 256):
                for words in rows.slice(i, 256).to_pylist():
                    start = len(values)
                    for w in words or ():
                        values += of(w)
                        if limit is not None and len(values) - start >= limit:
                            del values[start + limit:]
                            break
                    offsets.append(len(values))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    return run(tokens)


def encode_posts(posts: DataFrame, vocab: DataFrame, text_col: str = "posts",
                 id_col: str = "post_id", limit: int | None = dims.TOKEN_LIMIT,
                 ids: dict | None = None, specials: bool = True) -> DataFrame:
    """``(id, ids ARRAY<INT>, n_ids)``: wordpiece ids of each text, capped to
    ``limit`` ids, plus [CLS]/[SEP] (T6) unless ``specials`` is off, when a
    limit is given. Rows are encoded where they are; nothing is shuffled.

    Every basic token yields at least one id, so with a cap only the first
    ``limit`` tokens can contribute: the text is tokenized in full, but only
    those tokens are encoded - the result is identical."""
    ids = ids or vocab_ids(vocab)
    trie = posts.sparkSession.sparkContext.broadcast(piece_trie(vocab, ids))
    toks = T.basic_tokens(text_col)
    if limit is not None:
        toks = F.slice(toks, 1, limit)
    out = posts.select(id_col, encoded(toks, trie, limit).alias("ids"))
    if limit is not None and specials:
        out = out.withColumn("ids", F.concat(F.array(F.lit(int(ids["cls"]))), "ids", F.array(F.lit(int(ids["sep"])))))
    return out.withColumn("n_ids", F.size("ids"))


def constant_ids(spark, texts: list[str], vocab: DataFrame, ids: dict | None = None) -> list[list[int]]:
    """Ids of a few constant texts (an instruction, the class names)."""
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    tokens = df.select("k", T.basic_tokens("t").alias("w")).orderBy("k").collect()
    trie = piece_trie(vocab, ids)
    return [[i for w in r.w for i in trie.greedy(w)] for r in tokens]


def unk_rate(docs: DataFrame, vocab: DataFrame, text_col: str = "text",
             groups: tuple = ("lang",), ids: dict | None = None) -> DataFrame:
    """Share of words that become [UNK], per group. Token counts are
    aggregated per (group, word) first, so hot words collapse to one row each
    before tokenization; counts ride along, no join back."""
    wc = word_counts(docs, text_col, groups)
    j = tokenize_words(wc, vocab, carry=(*groups, "n"), ids=ids)
    return j.groupBy(*groups).agg(
        F.sum("n").alias("n_words"),
        F.sum(F.when(F.col("unk"), F.col("n")).otherwise(0)).alias("n_unk"),
        F.sum(F.col("n") * F.size("ids")).alias("n_ids"),
        F.round(F.sum(F.when(F.col("unk"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("unk_rate"))


def device_ids(words: DataFrame, vocab: DataFrame, word_col: str = "w", ids: dict | None = None) -> DataFrame:
    """``words`` with ``ids``: what the phone's tokenizer (F5) gives a word
    (:meth:`.piecetrie.PieceTrie.device`). What fits no piece is left out, and a
    word without a beginning in the vocabulary is dropped. Distinct words only."""
    trie = words.sparkSession.sparkContext.broadcast(piece_trie(vocab, ids))

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        device = trie.value.device
        return pa.array([device(w) for w in col.to_pylist()], pa.list_(pa.int32()))
    return words.withColumn("ids", run(word_col))


def device_rate(docs: DataFrame, vocab: DataFrame, text_col: str = "text",
                groups: tuple = ("source",), ids: dict | None = None) -> DataFrame:
    """Words, ids and dropped words (``tokens_dropped``) of the phone's
    tokenizer, per group: counted per word first, tokenized once per word."""
    wc = word_counts(docs, text_col, groups)
    words = device_ids(wc.select("w").distinct(), vocab, ids=ids).select("w", F.size("ids").alias("k"))
    per_word = wc.join(words, "w")
    return per_word.groupBy(*groups).agg(
        F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("k")).alias("n_ids"),
        F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("tokens_dropped"))
