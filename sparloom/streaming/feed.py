"""A change feed by polling: each snapshot is compared with the one before, which it then replaces as the baseline.

The stream is of marks, a line for each snapshot that is complete, naming its folder; the snapshots themselves are read
and compared as tables. A batch reads the baseline that the batch before left and writes its changes and its own
baseline to folders of its own number, so that a batch run again gives the same. Survey rows: STR-07, CDC-02.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import snapshot_diff

MARK = "snapshot long, folder string"
ACTIVITY = "snapshot long, kind string, n_files long"


def publish(snapshot: DataFrame, number: int, folder: str, marks: str) -> None:
    """Write a snapshot (path, hash) and then its mark."""
    snapshot.select("path", "hash").write.mode("overwrite").parquet(folder)
    snapshot.sparkSession.createDataFrame([(number, folder)], MARK).coalesce(1).write.mode("append").json(marks)


def poll(spark: SparkSession, marks: str, place: str, marks_per_batch: int = 1, stop_after: str | None = None) -> None:
    """Handle all marks that are new, in the order of their numbers within a batch. The first snapshot of all is the
    baseline and has no changes. stop_after: fail behind that step ("changes" or "baseline"), as tests do."""
    stream = spark.readStream.schema(MARK).option("maxFilesPerTrigger", marks_per_batch).json(marks)

    def handle(batch: DataFrame, n: int) -> None:
        held = None if n == 0 else spark.read.schema("path string, hash string").parquet(f"{place}/baseline/batch={n - 1}")
        # a batch has marks_per_batch marks at most
        for k, mark in enumerate(sorted(batch.collect())):
            now = spark.read.parquet(mark["folder"])
            first = held is None
            changes = snapshot_diff(now if first else held, now, "path", "hash").withColumn("snapshot", F.lit(mark["snapshot"]))
            changes.write.mode("overwrite").parquet(f"{place}/changes/batch={n}/part={k}")
            what = changes.sparkSession.read.parquet(f"{place}/changes/batch={n}/part={k}").agg(F.count("*").alias("n"))
            event = now.agg(F.count("*").alias("n")).select(F.lit("watch_started").alias("kind"), "n") if first else what.where("n > 0").select(F.lit("file_changed").alias("kind"), "n")
            event.select(F.lit(mark["snapshot"]).alias("snapshot"), "kind", F.col("n").alias("n_files")).write.mode("overwrite").parquet(f"{place}/activity/batch={n}/part={k}")
            held = now
        if stop_after == "changes":
            raise RuntimeError("stopped")
        if held is not None:
            held.write.mode("overwrite").parquet(f"{place}/baseline/batch={n}")
        _forget(spark, f"{place}/baseline/batch={n - 2}")
        if stop_after == "baseline":
            raise RuntimeError("stopped")

    stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def _forget(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def changes(spark: SparkSession, place: str) -> DataFrame:
    """snapshot, path, change of all batches so far."""
    return spark.read.schema("path string, change string, snapshot long, batch long, part long").parquet(f"{place}/changes").select("snapshot", "path", "change")


def activity(spark: SparkSession, place: str) -> DataFrame:
    """The watch's events: its start, and each snapshot in which files had changed."""
    return spark.read.schema(f"{ACTIVITY}, batch long, part long").parquet(f"{place}/activity").select("snapshot", "kind", "n_files")
