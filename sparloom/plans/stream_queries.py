"""Streams over ``events`` and the change feed, each written in several parts and restarted in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import place_for, stored
from ..streaming import feed as D
from ..streaming import logs as L
from ..streaming import states as S
from . import repo_queries as Q
from . import review_queries as V

IDLE_SECONDS = 6 * 3600
#: Parts by event number, and days of events.
PARTS = ("seq <= 5", "seq BETWEEN 6 AND 20", "seq > 20")


def _days(spark: SparkSession, d: str, place: str, k: int) -> None:
    """Append the events of the k-th ten days."""
    events = table(spark, d, "events")
    first = events.agg(F.min("ts").cast("date")).first()[0]
    nth = F.least(F.lit(2), F.floor(F.date_diff(F.col("ts").cast("date"), F.lit(first)) / 10))
    events.where(nth == k).write.mode("append").parquet(place)


def _restarted(spark: SparkSession, d: str, make, mode: str, keys=()) -> DataFrame:
    """Ten days of events run to their end as one batch, oldest first, each time from the checkpoint."""
    source, place = place_for(spark, "days"), place_for(spark, "stream")
    for k in range(3):
        _days(spark, d, source, k)
        out = L.run_to_end(make(L.source(spark, source)), mode, keys, place)
    return out


def mission_fold(spark, d):
    """The fold of all missions as a stream, restarted once."""
    events = stored(V.made(spark, d, V._MISSION), "missions")
    source, place = place_for(spark, "log"), place_for(spark, "stream")
    with S.keyed_state(spark):
        for part in PARTS:
            events.where(part).write.mode("append").parquet(source)
            out = L.run_to_end(S.missions(L.source(spark, source)), "update", ["mission"], place)
    return out


def idle(spark, d):
    with S.keyed_state(spark):
        return _restarted(spark, d, lambda e: S.idle_sessions(e, IDLE_SECONDS), "append")


def sliding(spark, d):
    return _restarted(spark, d, lambda e: L.windowed(e, "6 hours", "3 hours"), "append")


def session_windows(spark, d):
    return _restarted(spark, d, lambda e: L.sessions(e, "6 hours"), "append")


def hourly(spark, d):
    return _restarted(spark, d, L.hourly, "update", ["hour", "event_type"])


def _polled(spark: SparkSession, d: str) -> str:
    """Three snapshots of the source files: as they are, with one package edited, with a folder gone and another back."""
    f = Q.files(spark, d).select("path", F.sha2("content", 256).alias("hash"))
    edited = f.withColumn("hash", F.when(F.col("path").startswith("packages/p1/"), F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    shots = (f.where("path NOT LIKE 'docs/%'"), edited.where("path NOT LIKE 'docs/%'"), edited.where("path NOT LIKE 'lib/%'"))
    folder, marks, place = place_for(spark, "shots"), place_for(spark, "marks"), place_for(spark, "feed")
    for k, shot in enumerate(shots):
        D.publish(shot, k, f"{folder}/{k}", marks)
        if k:  # the first two in one go, the third after a restart
            D.poll(spark, marks, place)
    return place


QUERIES = {
    "stream_mission_fold": mission_fold, "stream_idle_sessions": idle, "stream_sliding": sliding, "stream_sessions": session_windows, "stream_hourly": hourly,
    "stream_change_feed": lambda s, d: D.changes(s, _polled(s, d)), "stream_activity": lambda s, d: D.activity(s, _polled(s, d)),
}
_RUNS = f"""marked AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
runs AS (SELECT user_id, t, count(*) FILTER ({{}}) OVER (PARTITION BY user_id ORDER BY t) AS nth FROM marked),
mark AS (SELECT (max(epoch_us(ts)) // 1000 - 86400000) AS ms FROM events),
over_ AS (SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM runs GROUP BY user_id, nth)"""
_MS = IDLE_SECONDS * 1000
_SHOTS = f"f AS ({Q._FILES}), chg AS (SELECT 1 AS snapshot, path, 'modified' AS change FROM f WHERE path LIKE 'packages/p1/%' UNION ALL SELECT 2, path, 'added' FROM f WHERE path LIKE 'docs/%' UNION ALL SELECT 2, path, 'deleted' FROM f WHERE path LIKE 'lib/%')"
ORACLES = {
    "stream_mission_fold": V.ORACLES["events_mission_fold"],
    "stream_idle_sessions": f"WITH {_RUNS.format(f'gap > {_MS * 1000}')} SELECT user_id, first, last, n FROM over_, mark WHERE (last + {_MS * 1000} + 999) // 1000 <= ms",
    "stream_sliding": """WITH w AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - to_hours(3 * k) AS s FROM events, range(2) r(k)), mark AS (SELECT max(ts) - INTERVAL '1 day' AS m FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w, mark WHERE s + INTERVAL '6 hours' <= m GROUP BY 1, 2""",
    "stream_sessions": f"WITH {_RUNS.format(f'gap >= {_MS * 1000}')} SELECT user_id, strftime(make_timestamp(first), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(make_timestamp(last + {_MS * 1000}), '%Y-%m-%d %H:%M:%S.%f') AS \"end\", n FROM over_, mark WHERE last + {_MS * 1000} <= ms * 1000",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_change_feed": f"WITH {_SHOTS} SELECT * FROM chg",
    "stream_activity": f"WITH {_SHOTS} SELECT snapshot, 'file_changed' AS kind, count(*) AS n_files FROM chg GROUP BY snapshot UNION ALL SELECT 0, 'watch_started', count(*) FROM f WHERE path NOT LIKE 'docs/%'",
}
