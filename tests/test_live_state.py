"""Session state: rows in order in bounded memory, scores kept up turn by turn,
batches committed whole."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetrad.operators import model
from tetrad.streaming import committed, livescore, transcript, turns


class _Map:
    def __init__(self):
        self.kept, self.most = {}, 0

    def updateValue(self, key, value):
        self.kept[key] = value
        self.most = max(self.most, len(self.kept))

    def getValue(self, key):
        return self.kept[key]

    def removeKey(self, key):
        del self.kept[key]


def _processor(**kw):
    p = turns.TurnProcessor(**kw)
    p.runs = _Map()
    return p


@pytest.mark.parametrize("run_chars", [300, 1 << 23])
def test_rows_of_a_trigger_come_in_turn_order(run_chars):
    rng = random.Random(5)
    rows = [(t, rng.choice([None, "", "x" * rng.randint(1, 40)]), rng.random() < 0.1) for t in range(500)]
    rows += [(7, "again", False), (7, "and again", False)]
    rng.shuffle(rows)
    frames = [pd.DataFrame(rows[a:a + 60], columns=["turn", "text", "is_stop"]) for a in range(0, len(rows), 60)]
    p = _processor(run_chars=run_chars, block_chars=100)
    assert list(p.in_order(iter(frames))) == sorted(rows, key=lambda r: r[0])
    assert not p.runs.kept and (p.runs.most > 10) == (run_chars == 300)


def _fitted():
    rng = np.random.default_rng(3)
    return model.BucketModel(rng.integers(-9_000_000, 0, (16 ** 3, 16)).astype(np.int32),
                             rng.integers(-9_000_000, 0, 16), 3)


def _whole(fitted, text, max_tokens=None):
    """Scores and tokens of a whole text."""
    words = livescore._TOKEN.findall(text)[:max_tokens]
    live = livescore.LiveScore(*fitted)
    return (fitted.prior + sum((live._row(w).astype(np.int64) for w in words), np.zeros(16, np.int64))).tolist(), len(words)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB3 .\té", max_size=6), max_size=12), st.sampled_from(["", " "]), st.sampled_from([None, 1, 4]))
def test_scores_of_every_prefix_equal_those_of_the_whole_text(parts, sep, max_tokens):
    fitted = _fitted()
    live = livescore.LiveScore(*fitted, sep=sep, max_tokens=max_tokens)
    live.stop()
    text = ""
    for part in parts:
        live.add(part)
        text = text + sep + part if text and part else text + part
        assert live.values() == _whole(fitted, text, max_tokens)


def test_stream_with_runs_laid_aside_equals_the_whole_texts(spark, tmp_dir):
    """One session of 3,000 turns in one trigger, a stop in it, then a second
    trigger that goes on from state."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["he", "llo ", "a.b", " ", None, "Zé"]), t == 1500) for t in range(3200)]
    first, second = rows[:3000], rows[3000:]
    rng.shuffle(first)
    schema = "session_id long, turn long, text string, is_stop boolean"
    want, text = {}, ""
    fitted = _fitted()
    for _, t, part, stop in rows:
        text = "" if stop else text + (part or "")
        if not stop:
            want[t] = text
    for some in (first, second):
        spark.createDataFrame(some, schema).repartition(3).write.mode("append").parquet(f"{tmp_dir}/src")
        u = transcript.read_utterances(spark, f"{tmp_dir}/src", schema)
        cap = transcript.Transcript(max_tokens=50, run_chars=20_000, block_chars=3_000)
        live = livescore.LiveScore(*fitted, max_tokens=50, run_chars=20_000, block_chars=3_000)
        with transcript.bounded_run(spark):
            qs = [turns.by_session(u, p, s).writeStream.option("checkpointLocation", f"{tmp_dir}/{n}-ckpt")
                  .format("parquet").trigger(availableNow=True).start(f"{tmp_dir}/{n}")
                  for n, p, s in (("text", cap, transcript.OUT_SCHEMA), ("live", live, livescore.OUT_SCHEMA))]
        for q in qs:
            q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/text").collect()
    assert len(got) == len(want) and not any(r.late for r in got)
    token = livescore._TOKEN
    for r in got:
        ends = [m.end() for m in token.finditer(want[r.turn])]
        cut = want[r.turn][:ends[49]] if len(ends) >= 50 else want[r.turn]
        assert (r.transcript, r.n_tokens) == (cut, min(50, len(ends)))
    for r in spark.read.parquet(f"{tmp_dir}/live").where("turn % 50 = 1").collect():
        assert (r.scores, r.n_tokens) == _whole(fitted, want[r.turn], 50)


def test_fitted_buckets_are_the_counts(spark):
    train = spark.createDataFrame([("Same same other", 0), ("other", 3)], "model_input string, target int")
    fitted = model.fit_buckets(train, digits=3)
    live = livescore.LiveScore(*fitted)
    assert live._row("same")[0] == int(np.floor(1e6 * np.log(3 / (3 + 4096))))
    assert live._row("other")[3] == int(np.floor(1e6 * np.log(2 / (1 + 4096))))
    assert live._row("same")[5] == int(np.floor(1e6 * np.log(1 / 4096)))
    assert fitted.prior[3] == int(np.floor(1e6 * np.log(2 / 18)))
    with pytest.raises(ValueError):
        livescore.live_scores(train, model.BucketModel(np.zeros((16 ** 4, 16), np.int32), fitted.prior, 4))


def test_a_killed_batch_never_shows(spark, tmp_dir):
    out = f"{tmp_dir}/out"
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, out)
    write = committed.committed_sink(lambda b: b.select("id"), out)
    write(spark.range(3), 0)
    broken = committed.committed_sink(lambda b: b.select(F.when(F.col("id") < 5, F.col("id")).otherwise(
        F.raise_error(F.lit("killed")).cast("long")).alias("id")), out)
    with pytest.raises(Exception, match="killed"):
        broken(spark.range(3, 9, numPartitions=6), 1)
    # written but not committed, as if the driver ended in between
    spark.range(100, 103).write.parquet(f"{out}/1-half")
    assert sorted(r.id for r in committed.read_committed(spark, out).collect()) == [0, 1, 2]
    write(spark.range(3, 5), 1)
    write(spark.range(50, 60), 1)                 # a replay after the commit changes nothing
    assert sorted(r.id for r in committed.read_committed(spark, out).collect()) == [0, 1, 2, 3, 4]
