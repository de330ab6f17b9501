"""Streams: restarts, state in keyed stores, expiry, late rows, the change feed after a killed batch."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparloom.operators import reviews
from sparloom.storage import place_for
from sparloom.streaming import feed, logs, states

EVENTS = "mission string, seq long, type string, key string, value string"


def written(spark, rows, place, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)


def log():
    out = [("m", 1, "mission.started", None, None), ("m", 2, "round.started", None, "3"), ("m", 3, "question.recorded", "q1", "open"), ("m", 4, "task.status_reported", "t1", "running")]
    out += [("m", 5, "control.message_sent", "t1", "pause_until_ack"), ("m", 6, "question.updated", "q1", "answered"), ("m", 7, "question.updated", "q2", "open"), ("m", 8, "control.message_acknowledged", "t1", "pause_until_ack")]
    out += [("m", 9, "gate.opened", None, None), ("m", 10, "control.message_sent", "t2", "immediate_stop"), ("m", 11, "round.started", None, "2"), ("m", 12, "gate.closed", None, None), ("m", 13, "evidence.recorded", None, None)]
    return out + [("n", 1, "mission.started", None, None), ("n", 2, "control.message_sent", "t1", "pause_until_ack"), ("n", 3, "error.recorded", None, None)]


def folded(spark, source, place, **k):
    with states.keyed_state(spark):
        return {r["mission"]: r.asDict() for r in logs.run_to_end(states.missions(logs.source(spark, source), **k), "update", ["mission"], place, once="ttl_ms" in k).collect()}


def test_fold_equals_batch_at_every_cut(spark):
    rows = log()
    want = {r["mission"]: r.asDict() for r in reviews.mission_states(spark.createDataFrame(rows, EVENTS)).collect()}
    source, place = place_for(spark, "log"), place_for(spark, "stream")
    for part in (rows[:4] + rows[13:14], list(reversed(rows[4:9])), rows[9:13] + rows[14:]):
        written(spark, part, source)
        got = folded(spark, source, place)
    assert got == want and got["m"]["running"] == 1 and got["m"]["interrupted"] == 1 and got["m"]["open_questions"] == 1 and got["n"]["paused"] == 1
    assert folded(spark, source, place) == want  # nothing new


def test_fold_after_a_killed_batch(spark):
    """A batch whose sink fails is run again from the state before it."""
    rows = log()
    source, place = place_for(spark, "log"), place_for(spark, "stream")
    written(spark, rows[:6] + rows[13:14], source)
    folded(spark, source, place)
    written(spark, rows[6:13] + rows[14:], source)

    def broken(batch, n):
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")
        raise RuntimeError("killed")

    with states.keyed_state(spark), pytest.raises(StreamingQueryException):
        states.missions(logs.source(spark, source)).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(broken).start().awaitTermination()
    assert folded(spark, source, place) == {r["mission"]: r.asDict() for r in reviews.mission_states(spark.createDataFrame(rows, EVENTS)).collect()}


def test_fold_needs_a_start(spark):
    source = place_for(spark, "log")
    written(spark, [("x", 1, "round.started", None, "1")], source)
    with pytest.raises(StreamingQueryException, match="before the start of mission x"):
        folded(spark, source, place_for(spark, "stream"))


def test_state_is_forgotten(spark):
    """Behind its time to live a mission begins anew (without one it goes on, as above)."""
    rows = [("m", k, "mission.started", None, None) for k in (1, 2)]
    source, place = place_for(spark, "log"), place_for(spark, "stream")
    for r in rows:
        written(spark, [r], source)
        got = folded(spark, source, place, ttl_ms=1)
        time.sleep(0.05)
    assert got["m"]["events"] == 1


def test_idle_sessions_and_late_rows(spark):
    base = 1_700_000_000
    make = lambda *at: [(u, base + s) for u, s in at]
    source, place = place_for(spark, "log"), place_for(spark, "stream")
    timed = lambda: logs.source(spark, source, 1).select("user_id", F.timestamp_seconds("s").alias("ts"), F.lit("e").alias("event_type"))

    def run(df, name, mode="append"):
        with states.keyed_state(spark):
            return {tuple(r) for r in logs.run_to_end(df, mode, place=f"{place}/{name}").collect()}

    def both():
        idle = {(u, a // 1_000_000 - base, z // 1_000_000 - base, n) for u, a, z, n in run(states.idle_sessions(timed(), 60, "10 seconds"), "idle")}
        return idle, {(t, n) for t, _, n in run(logs.windowed(timed(), "100 seconds", late="10 seconds"), "windows")}

    written(spark, make((1, 0), (1, 130), (1, 60), (2, 100), (1, 190)), source, "user_id int, s long")
    idle, _ = both()
    # at 190 with 10 seconds of delay, what ended by 120 is over
    assert idle == {(1, 0, 60, 2), (2, 100, 100, 1)}
    written(spark, make((3, 300), (1, 245)), source, "user_id int, s long")
    written(spark, make((4, 50), (4, 900)), source, "user_id int, s long")  # 50 is behind the watermark of 290
    idle, windows = both()
    assert (1, 0, 60, 2) in idle and (1, 130, 245, 3) in idle and (2, 100, 100, 1) in idle and (3, 300, 300, 1) in idle and len(idle) == 4
    assert sum(n for _, n in windows) == 7  # all but the late one and the window that is still open


@pytest.mark.parametrize("stop,per_batch", [(None, 2), ("changes", 1), ("baseline", 2)])
def test_feed(spark, tmp_path, stop, per_batch):
    shot = lambda **k: spark.createDataFrame(list(k.items()), "path string, hash string")
    marks, place = f"{tmp_path}/marks", f"{tmp_path}/feed"
    shots = [shot(a="1", b="1", c="1"), shot(a="1", b="2", d="1"), shot(a="1", b="2", d="1"), shot(b="3", d="1", c="9")]
    for k, s in enumerate(shots[:2]):
        feed.publish(s, k, f"{tmp_path}/{k}", marks)
    feed.poll(spark, marks, place, per_batch)
    for k, s in enumerate(shots[2:], 2):
        feed.publish(s, k, f"{tmp_path}/{k}", marks)
    if stop:
        with pytest.raises(StreamingQueryException, match="stopped"):
            feed.poll(spark, marks, place, per_batch, stop)
    feed.poll(spark, marks, place, per_batch)
    got = sorted(tuple(r) for r in feed.changes(spark, place).collect())
    assert got == [(1, "b", "modified"), (1, "c", "deleted"), (1, "d", "added"), (3, "a", "deleted"), (3, "b", "modified"), (3, "c", "added")]
    assert sorted(tuple(r) for r in feed.activity(spark, place).collect()) == [(0, "watch_started", 3), (1, "file_changed", 3), (3, "file_changed", 3)]
