"""Search of graph nodes: files, symbols and communities by the stems around them.

A node's stems come as rows from its file, symbols, neighbours and community and meet by node; those that the query
doesn't ask for go before anything is shuffled, and a community's stems are added up over its members, so that no list
of a hub's edges or of a community's members is made. Survey row: SCH-06.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import versions as V
from .fulltext import fingerprint
from .repo import file_of

#: Characters of a file's text that count.
HEAD = 2000


def records(files: DataFrame, found: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """id, kind, text: the parts of each node's text, in any number of rows. communities: node, community."""
    row = lambda df, kind, key, *text: df.select(F.concat(F.lit(f"graph:{kind}:"), key).alias("id"), F.lit(kind).alias("kind"), F.concat_ws(" ", *text).alias("text"))
    member = communities.withColumn("path", file_of(F.col("node"))).where("path IS NOT NULL").select("path", "community").distinct()
    out = row(files, "file", "path", F.lit("file"), "path", F.lit("language"), "language", F.substring(F.coalesce("content", F.lit("")), 1, HEAD))
    out = out.unionByName(row(found, "file", "path", F.lit("symbols"), "name")).unionByName(row(member, "file", "path", F.lit("communities"), "community"))
    out = out.unionByName(row(found, "symbol", "id", F.lit("symbol"), "name", F.lit("kind"), "kind", F.lit("file"), "path", F.lit("line"), F.col("line").cast("string")))
    near = edges.where("kind IN ('calls', 'references')")
    out = out.unionByName(row(near.where("contains(src, '#')"), "symbol", "src", F.lit("uses"), F.regexp_extract("dst", r"#([^:]*)", 1))).unionByName(row(near.where("contains(dst, '#')"), "symbol", "dst", F.lit("used by"), F.regexp_extract("src", r"#?([^#:]*)(?::|$)", 1)))
    return out.unionByName(row(communities.where("NOT startswith(node, 'external:')"), "community", "community", F.lit("community"), "community", F.lit("members"), "node"))


def build(files: DataFrame, found: DataFrame, edges: DataFrame, communities: DataFrame, place: str) -> str:
    """Write the stems of all nodes: id, kind, token, once each, with the files' fingerprint."""
    def write(folder: str) -> None:
        # words meet before they are stemmed, so that a word that many rows of a node hold is stemmed once
        words = records(files, found, edges, communities).select("id", "kind", F.explode(F.split(F.lower("text"), r"[^a-z0-9]+")).alias("word")).where("length(word) > 1").distinct()
        stems = words.select("id", "kind", X.stem(F.col("word")).alias("token")).distinct()
        stems.sortWithinPartitions("token").write.parquet(f"{folder}/stems")
        now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
        now.agg(fingerprint(now).alias("fingerprint")).write.parquet(f"{folder}/meta")

    return V.publish(files.sparkSession, place, write)


def search(files: DataFrame, place: str, q: str, kinds: list[str] | None = None, limit: int = 20) -> tuple[str, DataFrame]:
    """(state, rows id, kind, score): the share of the query's stems that a node has. state is ok, missing or stale; a
    missing or stale index gives no rows."""
    spark = files.sparkSession
    none = spark.createDataFrame([], "id string, kind string, score double")
    if V.current(spark, place) is None:
        return "missing", none
    now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    if V.opened(spark, place, "meta").first()["fingerprint"] != now.agg(fingerprint(now)).first()[0]:
        return "stale", none
    asked = spark.range(1).select(X.semantic_tokens(F.lit(q)).alias("t")).first()["t"]
    if not asked:
        return "ok", none
    rows = V.opened(spark, place, "stems").where(F.col("token").isin(asked))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds))
    scored = rows.groupBy("id", "kind").agg(F.round(F.count("*") / len(asked), 4).alias("score"))
    return "ok", scored.orderBy(F.desc("score"), "id").limit(limit)
