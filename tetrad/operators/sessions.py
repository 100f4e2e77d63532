"""Running transcript and marker sessions.

Both work in two levels, by blocks of a session's turns or minutes, so that a
session or user that holds a third of all rows is spread over many tasks.

``marker_sessions`` numbers sessions by counting stop markers before each
row. A plain running-sum window per user puts all of one user's rows in
one task; with a user holding a third of all rows that is one huge task.
Instead the running count is computed in two levels: per (user, time
block) totals, their running sum over blocks (a much smaller table), and a
running sum inside each block - exact, and a hot user is spread over its
blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.functions import text as T


#: turns of a session in one block of the running transcript
BLOCK_TURNS = 256


def _prefix_texts(utt: DataFrame, session: str, turn: str, text: str, sep: str) -> DataFrame:
    """``(session, turn, transcript)``: blocks of BLOCK_TURNS turn numbers are
    joined within, the text before a block once per block. What one task does
    for a whole session is thus 1 / BLOCK_TURNS of its output."""
    block = F.floor(F.col(turn) / BLOCK_TURNS).alias("_blk")
    d = utt.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.col(text).alias("_x"), block)

    def joined(parts):                          # null where there is no text at all
        return F.when(F.size(parts) > 0, F.array_join(parts, sep))
    whole = F.array_sort(F.collect_list(F.struct("_t", "_x")))
    blocks = d.where(F.col("_x").isNotNull()).groupBy("_s", "_blk") \
        .agg(F.array_join(F.transform(whole, lambda r: r["_x"]), sep).alias("_text"))
    blocks = d.select("_s", "_blk").distinct().alias("a").join(
        blocks.alias("b"), F.col("a._s").eqNullSafe(F.col("b._s")) & F.col("a._blk").eqNullSafe(F.col("b._blk")), "left") \
        .select("a._s", "a._blk", "_text")
    before = Window.partitionBy("_s").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select(F.col("_s").alias("_hs"), F.col("_blk").alias("_hb"),
                          joined(F.collect_list("_text").over(before)).alias("_head"))
    inside = Window.partitionBy("_s", "_blk").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.select("_s", "_t", "_blk", joined(F.collect_list("_x").over(inside)).alias("_in"))
    both = inner.join(heads, F.col("_s").eqNullSafe(F.col("_hs")) & F.col("_blk").eqNullSafe(F.col("_hb")), "left")
    return both.select(F.col("_s").alias(session), F.col("_t").alias(turn),
                       F.array_join(F.array_compact(F.array("_head", "_in")), sep).alias("transcript"))


def running_transcript(utt: DataFrame, session: str = "session_id", turn: str = "turn",
                       text: str = "text", sep: str = "", max_tokens: int | None = None) -> DataFrame:
    """Text so far after each utterance (W5). The reference appends every
    result without a separator; ``sep`` is a parameter. The output holds
    every prefix of a session's text, so its size is quadratic in the
    session length by definition; ``max_tokens`` keeps only the first N
    basic tokens of each (R4), as the stream does: turns before which more than
    N tokens stand for certain are found by sums alone, and no text is built
    for them - they repeat the session's capped text. Null texts add nothing."""
    if max_tokens is None:
        return _prefix_texts(utt, session, turn, text, sep)
    # two texts set side by side lose a token only where a word may go on from
    # one to the other: at most as often as texts begin, or end, with a word
    x = F.coalesce(F.col(text), F.lit(""))
    d = utt.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.col(text).alias("_x"),
                   F.coalesce(F.floor(F.col(turn) / BLOCK_TURNS), F.lit(-1 << 62)).alias("_blk"),
                   F.regexp_count(x, F.lit(T.BASIC_TOKEN)).cast("long").alias("_n"),
                   x.rlike(r"^\w").cast("long").alias("_starts"), x.rlike(r"\w$").cast("long").alias("_ends"))
    flags = ["_n", "_starts", "_ends"]
    totals = d.groupBy("_s", "_blk").agg(*[F.sum(c).alias(c) for c in flags])
    over = Window.partitionBy("_s").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(F.col("_s").alias("_hs"), F.col("_blk").alias("_hb"),
                          *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_h{c}") for c in flags])
    w = Window.partitionBy("_s", "_blk").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("_s", "_t", "_x", "_blk", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in flags])
    d = d.join(heads, F.col("_s").eqNullSafe(F.col("_hs")) & F.col("_blk").eqNullSafe(F.col("_hb")))
    n, starts, ends = (F.col(c) + F.col(f"_h{c}") for c in flags)
    least = n - F.least(starts, ends)
    # (all-null texts count nothing, so the last needed turn has the whole capped text)
    d = d.select("_s", "_t", "_x", (least <= max_tokens).alias("_open"))
    first = F.regexp_extract("transcript", r"^(?:\s*(?:\w+|\S)){%d}" % max_tokens, 0)
    cut = F.when(F.regexp_count("transcript", F.lit(T.BASIC_TOKEN)) >= max_tokens, first).otherwise(F.col("transcript"))
    built = _prefix_texts(d.where("_open"), "_s", "_t", "_x", sep).withColumn("transcript", cut)
    last = built.groupBy(F.col("_s").alias("_ls")).agg(F.max_by("transcript", F.struct("_t", F.length("transcript"))).alias("transcript"))
    rest = d.where("not _open").select("_s", "_t").join(last, F.col("_s").eqNullSafe(F.col("_ls")))
    return built.unionByName(rest.select("_s", "_t", "transcript")) \
        .select(F.col("_s").alias(session), F.col("_t").alias(turn), "transcript")


def running_count(df: DataFrame, part: Sequence[str], order: Sequence[str], flag: str,
                  block: str, out: str = "before", inclusive: bool = False) -> DataFrame:
    """Exact count of ``flag`` rows before each row within ``part`` in
    ``order`` (``order`` must start with the column ``block`` derives from,
    so blocks are ordered). Two-level: block totals -> prefix over blocks ->
    prefix inside a block."""
    part = list(part)
    f = F.col(flag).cast("long")
    totals = df.groupBy(*part, block).agg(F.sum(f).alias("_bt"))
    wb = Window.partitionBy(*part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, block, F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_off"))
    end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inner = df.withColumn("_in", F.coalesce(F.sum(f).over(wi), F.lit(0)))
    return (inner.join(offsets, [*part, block])
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_off", "_in"))


def marker_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts",
                    tie: str = "event_id", stop: str = "is_stop",
                    block_seconds: int = 60) -> DataFrame:
    """Session number of each event (W6): the count of stop markers strictly
    before it in (ts, tie) order - START begins, STOP clears. Blocks are
    ``block_seconds`` long (default one minute): a user's rows are split
    over its active minutes, and the per-(user, minute) totals are at most
    as many as the rows."""
    # any monotone function of ts works as a block; NTZ is read as session time
    blk = (F.unix_seconds(F.col(ts).cast("timestamp")) / block_seconds).cast("long")
    df = events.withColumn("_blk", blk)
    out = running_count(df, [user], ["_blk", ts, tie], stop, "_blk", out="session_no")
    return out.drop("_blk")
