"""Append logs in JSON lines: sink and replaying source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(events: DataFrame, path: str) -> None:
    """One JSON line for each row, added to the log."""
    events.write.mode("append").json(path)


def replay(spark: SparkSession, path: str, schema: T.StructType, tolerate_last: bool = False) -> DataFrame:
    """All rows of the log; blank lines are skipped. A bad line is an error, but for the last line of the
    file written last with tolerate_last."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    rows = lines.select("file", "at", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where("r._bad IS NOT NULL OR r IS NULL").select("file", "at").limit(2).collect()
    if bad:
        last = lines.agg(F.max_by("at", F.struct("file", "at")).alias("at")).first()["at"]
        if not tolerate_last or len(bad) > 1 or bad[0]["at"] != last:
            raise ValueError("the log has a line that is no JSON")
    return rows.where("r._bad IS NULL AND r IS NOT NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
