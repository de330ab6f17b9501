"""Queries of sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import parsers as P
from ..sources.tables import table
from ..streaming import logs as L

# Rules of owners.
OWNERS = "# comment\n/docs/ @writers\nsrc @core @team\nsrc/en @english\n* @all"


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], f"{col} string")


def owned(spark, d):
    paths = table(spark, d, "documents").select(F.concat(F.when(F.col("source") == "src1", "src/").otherwise("docs/"), F.col("lang"), F.lit("/x")).alias("path")).distinct()
    return P.owners(_one(spark, "text", OWNERS), paths)


def stream_profile(spark, d):
    return L.run_to_end(L.running_profile(L.source(spark, f"{d}/events.parquet")))


QUERIES = {
    "source_code_owners": owned, "stream_profile": stream_profile,
}
ORACLES = {
    "source_code_owners": "SELECT DISTINCT CASE WHEN source = 'src1' THEN 'src/' ELSE 'docs/' END || lang || '/x' AS path, CASE WHEN source = 'src1' AND lang = 'en' THEN '@all,@core,@english,@team' WHEN source = 'src1' THEN '@all,@core,@team' ELSE '@all,@writers' END AS owners FROM documents",
    "stream_profile": "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY event_type",
}
