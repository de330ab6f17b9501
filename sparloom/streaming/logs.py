"""Streams over growing logs, run to the end of what is there. Survey rows: STR-01, STR-02, STR-03, STR-06, STR-08,
STR-09, STR-10."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import place_for


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files at ``path``, whose schema is read from them."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a glob, the path may name a folder or one file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str = "complete", keys: Sequence[str] = (), place: str | None = None, once: bool = False) -> DataFrame:
    """The stream's result after all data there is. Each batch's result replaces the last (complete), is added (append)
    or replaces the rows of equal keys (update). Checkpoint and results lie in ``place``, by default a new one; a stream
    that is run again in its place goes on where it ended, and a batch that was cut off replaces what it had written.
    once: take all there is in one batch, as states that expire by the clock need, which else never come to an end."""
    spark = stream.sparkSession
    place = place or place_for(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(**({"once": True} if once else {"availableNow": True})).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{place}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return out.select(*stream.columns)


def running_profile(events: DataFrame) -> DataFrame:
    """Counts and sums of values by event type, kept while the log grows."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000000).cast("long")).alias("micros"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events by window and type. A window's state goes when the watermark, ``late`` behind the latest event, has passed
    its end; an event behind the watermark is dropped. In append mode a window comes out once, when it is over; in
    update mode its count so far does, whenever it changes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by hour and type, for update mode."""
    return windowed(events, "1 hour", None, late).withColumnRenamed("start", "hour")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, end, n of runs of a user's events that are less than ``gap`` apart, once they are over (append
    mode); end is the last event's time and the gap."""
    w = F.session_window("ts", gap).alias("w")
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _timed(events, late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", time("w.start").alias("start"), time("w.end").alias("end"), "n")
