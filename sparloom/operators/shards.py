"""An index in shards by root folder, refreshed shard by shard, and the ladder of ways to answer a query.

A shard's rows lie in a folder of the refresh that wrote them; the manifest names each shard's folder, counts, bytes,
lane and fingerprint. A refresh compares fingerprints, writes the shards that differ to a new folder and swaps the
manifest, so that readers see all of it or nothing. A query reads the shards of its lanes. Survey rows: SRC-14, SCH-03,
TOP-02.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import versions as V
from . import fulltext as T
from .repo import file_of

#: Lanes in the order that decides between equally frequent ones.
LANES = ("runtime", "tests", "fixtures", "benchmarks", "docs", "generated")
_KEY = ["shard", "refresh"]


def _manifest(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """shard, lane (its most frequent), counts, bytes, fingerprint of what the shards should hold."""
    place = F.array_position(F.array(*map(F.lit, LANES)), F.col("lane"))
    by_lane = files.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    lanes = by_lane.groupBy("shard").agg(F.max_by("lane", F.struct("n", -place)).alias("lane"))
    sums = files.groupBy("shard").agg(F.count("*").alias("files"), F.sum("byte_length").alias("bytes"), T.fingerprint(files).alias("fingerprint"))
    count = lambda df, name: df.groupBy("shard").agg(F.count("*").alias(name))
    out = sums.join(lanes, "shard").join(count(symbols, "symbols"), "shard", "left").join(count(edges, "edges"), "shard", "left")
    return out.select("shard", "lane", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("edges", F.lit(0)).alias("edges"), "bytes", "fingerprint")


def refresh(files: DataFrame, found: DataFrame, edges: DataFrame, place: str) -> DataFrame:
    """Bring the shards up to files (path, language, content), their symbols and edges; shard and what was done with it:
    added, rewritten, kept or removed. An edge belongs to the shard of its source's file."""
    spark = files.sparkSession
    shard = P.shard_root(F.col("path")).alias("shard")
    rows = T.prepared(files, found).withColumn("shard", F.col("shard_root"))
    symbols = T.symbol_rows(found).select("*", shard)
    links = edges.withColumn("path", file_of(F.col("src"))).where("path IS NOT NULL").select("*", shard).distinct()
    new, stamp = _manifest(rows, symbols, links), uuid.uuid4().hex
    before = V.current(spark, place)
    old = V.opened(spark, place, "manifest") if before else new.limit(0).withColumn("refresh", F.lit(stamp))
    told = old.select("shard", F.struct("fingerprint", "symbols", "edges").alias("was"), "refresh")
    both = new.withColumn("now", F.struct("fingerprint", "symbols", "edges")).join(told, "shard", "full_outer")
    step = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("now") == F.col("was"), "kept").otherwise("rewritten")

    def write(folder: str) -> None:
        both.withColumn("step", step).withColumn("refresh", F.when(step == "kept", F.col("refresh")).otherwise(F.lit(stamp))).drop("now", "was").write.parquet(f"{folder}/steps")
        steps = spark.read.parquet(f"{folder}/steps")
        due = steps.where("step IN ('added', 'rewritten')").select("shard")
        for name, df in (("files", rows), ("symbols", symbols), ("edges", links)):
            some = df.join(due, "shard", "left_semi").withColumn("refresh", F.lit(stamp))
            some.hint("rebalance", "shard").write.partitionBy(*_KEY[::-1]).mode("append").parquet(f"{place}/{name}")
        steps.where("step <> 'removed'").drop("step").coalesce(1).write.parquet(f"{folder}/manifest")

    folder = V.publish(spark, place, write)
    return spark.read.parquet(f"{folder}/steps").select("shard", "step")


def manifest(spark: SparkSession, place: str) -> DataFrame:
    return V.opened(spark, place, "manifest")


def opened(spark: SparkSession, place: str, name: str, lanes: list[str] | None = None) -> DataFrame:
    """A table of the shards that the manifest names, of some lanes or all; other folders are not read."""
    m = manifest(spark, place)
    m = m if lanes is None else m.where(F.col("lane").isin(lanes))
    return spark.read.parquet(f"{place}/{name}").join(m.select(*_KEY), _KEY, "left_semi")


def search(spark: SparkSession, place: str, q: str, lanes: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The best rows over the shards whose lane is asked for."""
    return T.ranked(opened(spark, place, "files", lanes), opened(spark, place, "symbols", lanes), q, "fixed", limit)


def retrieve(spark: SparkSession, q: str, index: str, shards: str, full: tuple[DataFrame, DataFrame] | None = None, lanes: list[str] | None = None, limit: int = 10, require_fresh: bool = False, now: DataFrame | None = None) -> DataFrame:
    """The answer of the first way that there is, with its name as retrieval_mode: refused (a fresh index is asked for
    and there is none for the files ``now``), fts, like, manifest, full (prepared files and symbols in memory)."""
    with_mode = lambda df, mode: df.withColumn("retrieval_mode", F.lit(mode))
    none = spark.createDataFrame([], "kind string, path string, line long, score long, title string, excerpt string")
    facts = T.metadata(spark, index)
    if require_fresh and not T.status(spark, index, now).first()["fresh"]:
        return with_mode(none, "refused")
    if facts:
        mode = "fts" if facts["ftsAvailable"] == "true" else "like"
        return with_mode(T.search(spark, index, q, lanes, limit, mode), mode)
    if V.current(spark, shards) is not None:
        return with_mode(search(spark, shards, q, lanes, limit), "manifest")
    if full is None:
        return with_mode(none, "missing")
    return with_mode(T.ranked(*full, q, "fixed", limit), "full")
