"""Tables that are replaced as a whole: each write goes to a folder of its own, and one file names the folder that counts.

A reader opens the folder named when it begins; a writer that fails leaves the name as it is. The last version but
one is kept for readers that have begun, older ones are deleted. Survey rows: SRC-09, SRC-14.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _files(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, place: str) -> str | None:
    """The folder that counts, or None before the first write."""
    fs, path = _files(spark, place)
    if not fs.exists(path(f"{place}/{POINTER}")):
        return None
    name = spark.read.text(f"{place}/{POINTER}").first()["value"]
    return f"{place}/{name}"


def point(spark: SparkSession, place: str, name: str) -> None:
    """Let this folder count, in one step."""
    fs, path = _files(spark, place)
    jvm, new = spark.sparkContext._jvm, f"{place}/.{POINTER}-{uuid.uuid4().hex}"
    out = fs.create(path(new), True)
    try:
        out.write(bytearray(name, "utf-8"))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(place).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(path(new)), context.makeQualified(path(f"{place}/{POINTER}")), how)


def publish(spark: SparkSession, place: str, write: Callable[[str], None]) -> str:
    """Call write with a new folder and let it count; returns the folder."""
    before = current(spark, place)
    name = f"v-{uuid.uuid4().hex}"
    write(f"{place}/{name}")
    point(spark, place, name)
    fs, path = _files(spark, place)
    for status in fs.listStatus(path(place)):
        old = status.getPath().getName()
        if old.startswith("v-") and f"{place}/{old}" not in (before, f"{place}/{name}"):
            fs.delete(status.getPath(), True)
    return f"{place}/{name}"


def opened(spark: SparkSession, place: str, table: str) -> DataFrame:
    """A table of the version that counts."""
    return spark.read.parquet(f"{current(spark, place)}/{table}")
