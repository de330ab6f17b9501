"""A store of fact graphs, one per root, and facts kept by content.

Writing a root replaces that root's partition alone. Its rows, nodes before edges in the order of their keys, carry
their number, and lie in files of at most PAGE_FILE rows in that order: a page is a range of numbers, which the reader
finds by the files' own statistics, so that no page costs more than another. Facts by content are drawn once for each
content that was not seen before. Survey rows: SRC-11, SRC-12, CDC-06, SRC-31, CDC-09.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import versions as V
from ..storage import stored

#: Rows of one file of the store at most.
PAGE_FILE = 10_000
EXTRACTOR = "1"
_ROWS = "nth long, part string, node string, src string, dst string, kind string, line long, confidence double, repo_root string"
_META = "repo_root string, fingerprint string, extractor string, options string, nodes long, edges long"


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """nth, from 0, in an order over all rows: ranges are sorted apart and begin where those before them end."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    # a row for each range
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "_range").withColumn("nth", nth).drop("_range", "_before")


def canonical(options: dict) -> str:
    return json.dumps(options, sort_keys=True, separators=(",", ":"))


def write(nodes: DataFrame, edges: DataFrame, place: str, root: str, fingerprint: str, options: dict | None = None, extractor: str = EXTRACTOR) -> None:
    """Replace the facts of one root: nodes (node, kind) and edges (src, dst, kind, line, confidence)."""
    spark = nodes.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    a = nodes.select(F.lit("node").alias("part"), "node", none("string").alias("src"), none("string").alias("dst"), "kind", none("long").alias("line"), none("double").alias("confidence"))
    b = edges.select(F.lit("edge").alias("part"), none("string").alias("node"), "src", "dst", "kind", F.col("line").cast("long").alias("line"), "confidence")
    rows = a.unionByName(b).withColumn("_edge", (F.col("part") == "edge").cast("int"))
    placed = _numbered(rows, ["_edge", "node", "src", "kind", "dst", "line"]).drop("_edge").withColumn("repo_root", F.lit(root))
    # files in order of the numbers, each of a range of them
    whole = stored(placed, "facts")
    n = whole.groupBy("part").count().collect()
    sizes = {r["part"]: r["count"] for r in n}
    files = max(1, -(-sum(sizes.values()) // PAGE_FILE))
    out = whole.repartitionByRange(files, "nth").sortWithinPartitions("nth").select(*[c.split()[0] for c in _ROWS.split(", ")])
    dynamic = {"partitionOverwriteMode": "dynamic"}
    out.write.mode("overwrite").options(**dynamic, maxRecordsPerFile=str(PAGE_FILE)).partitionBy("repo_root").parquet(f"{place}/rows")
    meta = spark.createDataFrame([(root, fingerprint, extractor, canonical(options or {}), sizes.get("node", 0), sizes.get("edge", 0))], _META)
    meta.coalesce(1).write.mode("overwrite").options(**dynamic).partitionBy("repo_root").parquet(f"{place}/meta")


def _read(spark: SparkSession, place: str, table: str, schema: str) -> DataFrame:
    fs, path = V._files(spark, place)
    return spark.read.schema(schema).parquet(f"{place}/{table}") if fs.exists(path(f"{place}/{table}")) else spark.createDataFrame([], schema)


def roots(spark: SparkSession, place: str) -> DataFrame:
    """repo_root, fingerprint, extractor, options, nodes, edges of all that is stored."""
    return _read(spark, place, "meta", _META)


def page(spark: SparkSession, place: str, root: str, cursor: int = 0, limit: int = 50) -> tuple[DataFrame, int | None]:
    """Rows ``cursor`` to ``cursor + limit`` of a root, and the next cursor, or None behind the last."""
    rows = _read(spark, place, "rows", _ROWS).where((F.col("repo_root") == root) & (F.col("nth") >= cursor) & (F.col("nth") < cursor + limit))
    m = roots(spark, place).where(F.col("repo_root") == root).first()
    end = m["nodes"] + m["edges"] if m else 0
    return rows.drop("repo_root"), cursor + limit if cursor + limit < end else None


def status(spark: SparkSession, place: str, root: str, current: dict | None = None) -> DataFrame:
    """One row: present, fresh, nodes, edges and the reasons why stored facts are stale. current: fingerprint, extractor,
    options and fresh of the index that there is now, or None if there is none."""
    m = roots(spark, place).where(F.col("repo_root") == root).first()
    reasons = []
    if m is None:
        reasons.append("store_missing")
    else:
        checks = [("fact_extractor_version_mismatch", m["extractor"] != EXTRACTOR)]
        if current is None:
            checks.append(("current_index_missing", True))
        else:
            checks += [
                ("current_index_stale", not current["fresh"]), ("fact_fingerprint_mismatch", m["fingerprint"] != current["fingerprint"]), ("current_extractor_version_mismatch", current["extractor"] != EXTRACTOR),
                ("fact_extractor_version_mismatch", m["extractor"] != current["extractor"]), ("build_options_mismatch", m["options"] != canonical(current["options"])),
            ]
        reasons = list(dict.fromkeys(name for name, hit in checks if hit))
    row = (root, m is not None, not reasons, m["nodes"] if m else 0, m["edges"] if m else 0, reasons)
    return spark.createDataFrame([row], "repo_root string, present boolean, fresh boolean, nodes long, edges long, reasons array<string>")


def put(records: DataFrame, place: str, order: str) -> DataFrame:
    """Add records (content and other columns) whose content is new, the first by ``order`` of each; the records that
    were added, under key and byte_length."""
    keyed = records.withColumn("key", F.concat(F.lit("sha256:"), F.sha2("content", 256))).withColumn("byte_length", F.octet_length("content").cast("long"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*keyed.columns), order).alias("r")).select("r.*")
    new = first.join(_read(records.sparkSession, place, "records", "key string").select("key"), "key", "left_anti")
    new = stored(new, "new")
    new.write.mode("append").parquet(f"{place}/records")
    return new


def by_content(files: DataFrame, place: str, kind: str, extract: Callable[[DataFrame], DataFrame], version: str = EXTRACTOR) -> tuple[DataFrame, DataFrame]:
    """(facts of all files, keys that were drawn now). extract gives rows with a path from files (path, language,
    content) and may use no other file. Each language and content is drawn once for each version, ever; facts are
    joined to the files that have it now. A run that fails leaves the keys that it did not finish undone."""
    spark = files.sparkSession
    language = F.col("language") if "language" in files.columns else P.language(F.col("path"))
    key = F.sha2(F.concat_ws("\n", F.coalesce(language, F.lit("")), F.coalesce("content", F.lit(""))), 256)
    keyed = files.select("path", language.alias("language"), "content", key.alias("key"))
    home = f"{place}/{kind}-{version}"
    done = _read(spark, home, "keys", "key string, run string")
    new = keyed.join(done, "key", "left_anti").groupBy("key").agg(F.first(F.struct("language", "content")).alias("f"))
    new = stored(new.select(F.col("key").alias("path"), "f.language", "f.content"), "unseen")
    run = uuid.uuid4().hex
    extract(new).withColumnRenamed("path", "key").withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{home}/facts")
    # keys count last: facts of a run without keys are not read
    new.select(F.col("path").alias("key"), F.lit(run).alias("run")).write.mode("append").parquet(f"{home}/keys")
    keys = spark.read.parquet(f"{home}/keys")
    facts = spark.read.parquet(f"{home}/facts").join(keys, ["key", "run"], "left_semi").drop("run")
    return keyed.select("path", "key").join(facts, "key").drop("key"), new.select(F.col("path").alias("key"))
