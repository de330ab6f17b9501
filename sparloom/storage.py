"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on one machine alone, /tmp/checkpoints stands in."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    place = spark.conf.get("spark.checkpoint.dir", own)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "/tmp/checkpoints"
    return place


def place_for(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is cleared when the driver ends."""
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    if not _made:
        atexit.register(drop_all)
    _made[place] = (path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read from there."""
    place = place_for(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def drop_all() -> None:
    """Delete all of these tables; what is computed from them can't be read any more."""
    while _made:
        _, (path, files) = _made.popitem()
        try:
            files.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return
