"""Streaming transcript: equals the batch window, survives a restart,
bounded state."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tetrad.operators import sessions
from tetrad.plans import fixtures as fx
from tetrad.streaming import transcript


def _write(spark, df, path):
    df.write.mode("append").parquet(path)


def _run(spark, src, ckpt, out, max_tokens=None):
    s = transcript.running_transcript_stream(transcript.read_utterances(spark, src), max_tokens=max_tokens)
    with transcript.bounded_run(spark):
        q = (s.writeStream.option("checkpointLocation", ckpt).format("parquet")
             .trigger(availableNow=True).start(out))
    q.awaitTermination()


def test_stream_equals_batch_with_restart(spark, tmp_dir):
    u = fx.utterances(spark, SF_SMALL)
    src, ckpt, out = f"{tmp_dir}/src", f"{tmp_dir}/ckpt", f"{tmp_dir}/out"
    _write(spark, u.where("turn <= 1"), src)
    _run(spark, src, ckpt, out)
    # stop, more data arrives, resume from the checkpoint
    _write(spark, u.where("turn between 2 and 3"), src)
    _write(spark, u.where("turn >= 4"), src)
    _run(spark, src, ckpt, out)
    assert spark.read.parquet(out).where("late").count() == 0
    got = spark.read.parquet(out).select("session_id", "turn", "transcript")
    want = sessions.running_transcript(u)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_late_turns_are_marked_and_stop_clears(spark, tmp_dir):
    src, ckpt, out = f"{tmp_dir}/src", f"{tmp_dir}/ckpt", f"{tmp_dir}/out"
    schema = "session_id long, turn long, text string, is_stop boolean"

    def run():
        s = transcript.running_transcript_stream(transcript.read_utterances(spark, src, schema=schema))
        with transcript.bounded_run(spark):
            q = (s.writeStream.option("checkpointLocation", ckpt).format("parquet")
                 .trigger(availableNow=True).start(out))
        q.awaitTermination()
    _write(spark, spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", False)], schema), src)
    run()
    _write(spark, spark.createDataFrame([(1, 1, "b", False), (1, 2, None, True), (1, 3, "c", False)], schema), src)
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.turn, r.transcript) for r in rows if not r.late) == [(0, "a"), (1, "ab"), (3, "c")]
    assert [(r.turn, r.transcript) for r in rows if r.late] == [(1, None)]


def test_text_is_full_only_when_its_last_token_cannot_grow():
    add = transcript._append
    assert add("", "hel", "", 0, False, 1) == ("hel", 1, False)
    assert add("hel", "lo world", "", 1, False, 1) == ("hello", 1, True)
    assert add("hello", " more", "", 1, True, 1) == ("hello", 1, True)
    assert add("a", ".", "", 1, False, 2) == ("a.", 2, True)
    assert add("hel", "lo", "", 1, False, None) == ("hello", 1, False)
    assert add("hel", "lo", " ", 1, False, None) == ("hel lo", 2, False)
    assert add("a b", " ", "", 2, False, 2) == ("a b", 2, True)


def test_bounded_state_caps_tokens(spark, tmp_dir):
    u = fx.utterances(spark, SF_SMALL)
    src, ckpt, out = f"{tmp_dir}/src", f"{tmp_dir}/ckpt", f"{tmp_dir}/out"
    _write(spark, u, src)
    _run(spark, src, ckpt, out, max_tokens=20)
    got = spark.read.parquet(out)
    assert got.agg(F.max("n_tokens")).first()[0] <= 20
    # once full, the transcript does not change any more
    full = got.where("n_tokens = 20").groupBy("session_id").agg(F.countDistinct("transcript").alias("d"))
    assert full.where("d > 1").count() == 0
