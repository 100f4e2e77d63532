"""Fixtures derived from the driver's tables (see FIXTURES.md).

The reference ships no data, so its inputs (labelled posts, model scores,
generated answers, utterances) are derived from the given tables with
plain column expressions - the same definitions are written in SQL in
:mod:`tetrad.plans.oracle`. Every fixture grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import text as T
from tetrad.operators import wordpiece as wp
from tetrad.sources.tables import read_table, spread


def class_of(doc_id) -> F.Column:
    """Fixture class index of a document: skewed, classes 0-6 twice as big."""
    return (((doc_id * 7 + F.floor(doc_id / 5)) % 23) % 16).cast("int")


def post_type(doc_id) -> F.Column:
    return F.upper(F.element_at(dims.class_name_array(), class_of(doc_id) + 1))


def posts(spark: SparkSession, base: str) -> DataFrame:
    """``posts(post_id LONG, posts STRING, type STRING)`` from ``documents``."""
    d = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("post_id"), F.col("text").alias("posts"),
                    post_type(F.col("doc_id")).alias("type"))


def post_types(spark: SparkSession, base: str) -> DataFrame:
    """``posts`` without the text, for planning: ids, labels, and whether the
    text is there."""
    d = spread(read_table(spark, base, "documents").select("doc_id", F.col("text").isNotNull().alias("has_text")))
    return d.select(F.col("doc_id").alias("post_id"), post_type(F.col("doc_id")).alias("type"), "has_text")


def score_logits(doc_id) -> F.Column:
    """16 synthetic logits per post: z_i = ((id*(31+17i) + 7i^2) % 101) / 10."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: ((doc_id * (F.lit(31) + i * 17) + i * i * 7) % 101).cast("double") / 10.0,
    )


def scores(spark: SparkSession, base: str) -> DataFrame:
    """``(post_id, gold, z ARRAY<DOUBLE>(16))``: one row per post, the model
    output in its wide form (ranking needs no shuffle)."""
    p = post_types(spark, base)
    return p.select("post_id", F.lower("type").alias("gold"),
                    score_logits(F.col("post_id")).alias("z"))


def axis_probs(doc_id) -> F.Column:
    """4 synthetic P(second letter) per post: ((id*(13+5i) + 3i) % 97) / 96."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: ((doc_id * (F.lit(13) + i * 5) + i * 3) % 97).cast("double") / 96.0,
    )


def axis_scores(spark: SparkSession, base: str) -> DataFrame:
    """``(post_id, gold, p1 ARRAY<DOUBLE>(4))``; p0 = 1 - p1 per axis."""
    p = post_types(spark, base)
    return p.select("post_id", F.lower("type").alias("gold"),
                    axis_probs(F.col("post_id")).alias("p1"))


def answers(doc_id) -> F.Column:
    return F.element_at(dims.class_name_array(), ((doc_id * 5 + 3) % 16).cast("int") + 1)


def generations(spark: SparkSession, base: str) -> DataFrame:
    """``(post_id, gold, g, naive)``: synthetic generator output, the whole
    prompt (300 words of the post) and an answer.

    g by post_id % 4: 0 well-formed, 1 no end marker, 2 a space before the
    end marker, 3 the post without prompt and answer marker. The answer is
    class (id*5+3) % 16. The greedy next token ``naive`` is class
    (id*11) % 16, cut to 2 letters when id % 5 = 0 (a wrong-length answer).
    """
    p = posts(spark, base)
    pid = F.col("post_id")
    ans = answers(pid)
    head = T.prompt("posts", GENERATION_WORDS, indent=8)
    g = (F.when(pid % 4 == 0, F.concat(head, ans, F.lit(dims.END_MARK)))
         .when(pid % 4 == 1, F.concat(head, ans))
         .when(pid % 4 == 2, F.concat(head, ans, F.lit(" " + dims.END_MARK)))
         .otherwise(F.concat(F.lit("[Text]\n"), F.col("posts"), F.lit("\n"), ans, F.lit(dims.END_MARK))))
    nv = F.element_at(dims.class_name_array(), ((pid * 11) % 16).cast("int") + 1)
    naive = F.when(pid % 5 == 0, F.substring(nv, 1, 2)).otherwise(nv)
    return p.select("post_id", F.lower("type").alias("gold"), g.alias("g"), naive.alias("naive"))


#: words of a post in the generator's prompt
GENERATION_WORDS = 300


def token_rows(spark: SparkSession, base: str, vocab: DataFrame, ids: dict) -> DataFrame:
    """``(post_id, type, prompt_ids, target_ids)``: WordPiece ids of the whole
    generation prompt and of the class name. The instruction is the same in
    every row and is tokenized once; of a post only what fits the model after
    it can matter."""
    fixed = wp.constant_ids(spark, [dims.instruction(8), *dims.CLASS_NAMES], vocab, ids)
    head, names = fixed[0], fixed[1:]
    body = F.concat(T.first_words("posts", GENERATION_WORDS), F.lit(f"\n{dims.ANSWER_MARK}\n"))
    p = posts(spark, base).select("post_id", body.alias("body"))
    e = wp.encode_posts(p, vocab, "body", limit=dims.MAX_LENGTH, ids=ids, specials=False)
    rows = e.select("post_id", post_type(F.col("post_id")).alias("type"),
                    F.concat(F.array(*[F.lit(i) for i in head]), "ids").cast("array<bigint>").alias("prompt_ids"))
    of = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in x]) for x in names])
    return rows.withColumn("target_ids", F.element_at(of, class_of(F.col("post_id")) + 1))


def utterances(spark: SparkSession, base: str) -> DataFrame:
    """``(session_id, turn, text)`` from ``conversations``."""
    c = spread(read_table(spark, base, "conversations").select("conv_id", "turn", "text"))
    return c.select(F.col("conv_id").alias("session_id"), "turn", "text")


def marked_events(spark: SparkSession, base: str) -> DataFrame:
    """``(user_id, ts, event_id, is_stop)``: 'signup' plays the stop marker."""
    e = spread(read_table(spark, base, "events").select("user_id", "ts", "event_id", "event_type"))
    return e.select("user_id", "ts", "event_id",
                    (F.col("event_type") == "signup").alias("is_stop"))
