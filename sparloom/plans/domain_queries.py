"""The domain index over source files, guides, interface descriptions, tables of migrations, owners and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import discovery as D
from ..operators import domain as M
from ..operators import repo as R
from ..sources import parsers as S
from ..sources.tables import table
from ..storage import place_for
from . import given_queries as G
from . import repo_queries as Q

DEPTH = 2
#: A feature for each size of parts, with a file, an endpoint and a table for each of its parts; every fifth of these
#: endpoints is written without its part's name.
_FEATURES = f"SELECT 'size' || s AS feature, {Q._PATH} AS path, CASE WHEN k % 5 = 0 THEN 'GET /' || k ELSE 'GET /' || w || '/' || k END AS endpoint, 't_' || translate(CAST(k AS STRING), '0123456789', 'abcdefghij') AS tbl, '@b' || b AS owner FROM (SELECT p_partkey AS k, p_size AS s, lower(split_part(p_name, ' ', 1)) AS w, replace(p_brand, 'Brand#', '') AS b FROM {{part}}) p"


def _index(spark: SparkSession, d: str) -> str:
    f, _, edges = Q._graph(spark, d)
    made = G.made(spark, d, _FEATURES.replace("{{", "{").replace("}}", "}"))
    path = F.col("path")
    kind = lambda c: F.when(P.is_test(c), "test").when(c.endswith(".md"), "guide").otherwise("file")
    entity = lambda df, kind, key, source, name=None: df.select(kind.alias("kind"), F.col(key).alias("key"), F.col(name or key).alias("name"), F.lit(source).alias("source"))
    spec = S.openapi(G.made(spark, d, G._SPEC)).withColumn("key", F.concat_ws(" ", "method", "path"))
    entities = [
        entity(f, kind(path), "path", "files"), entity(spec, F.lit("endpoint"), "key", "description", "path"), entity(D.ddl_fold(G.made(spark, d, G._DDL)), F.lit("table"), "name", "migrations"),
        entity(made, F.lit("feature"), "feature", "manifest"), entity(made, F.lit("owner"), "owner", "owners"),
    ]
    refer = lambda df, a, b, to, c, why: df.select(a.alias("from_kind"), b.alias("from_key"), to.alias("to_kind"), c.alias("to_key"), F.lit(why).alias("why"))
    imports = edges.where("kind = 'imports' AND NOT startswith(dst, 'external:')")
    feature, key = F.lit("feature"), F.col("feature")
    references = [
        refer(imports, kind(F.col("src")), F.col("src"), kind(F.col("dst")), F.col("dst"), "imports"), refer(made, feature, key, kind(path), path, "files"), refer(made, feature, key, F.lit("endpoint"), F.col("endpoint"), "endpoints"),
        refer(made, feature, key, F.lit("table"), F.col("tbl"), "tables"), refer(made, F.lit("owner"), F.col("owner"), kind(path), path, "owns"),
    ]
    place = place_for(spark, "domain")
    M.build(entities, references, place)
    return place


def sliced(spark, d):
    """What lies within two references of two features, but for owners."""
    place = _index(spark, d)
    start = spark.createDataFrame([("feature", "size7"), ("feature", "size8"), ("feature", "none")], "kind string, key string")
    return M.slice_of(spark, place, start, DEPTH, ["feature", "file", "guide", "endpoint", "table", "test"])


QUERIES = {"domain_index_summary": lambda s, d: M.summary(s, _index(s, d)), "domain_slice": sliced}
_KIND = "CASE WHEN {0} LIKE 'tests/%' THEN 'test' WHEN {0} LIKE '%.md' THEN 'guide' ELSE 'file' END"
_INDEX = f"""{Q._EDGES}, ft AS ({G.duck(_FEATURES)}), sp AS (SELECT p_partkey AS k, p_size AS s, lower(split_part(p_name, ' ', 1)) AS w FROM part),
ent AS (SELECT DISTINCT * FROM (SELECT {_KIND.format('path')} AS kind, path AS key, path AS name FROM files UNION ALL SELECT 'endpoint', 'GET /' || w || '/' || k, '/' || w || '/' || k FROM sp UNION ALL SELECT 'endpoint', 'POST /' || w || '/' || k, '/' || w || '/' || k FROM sp WHERE s % 2 = 0
 UNION ALL SELECT 'table', tbl, tbl FROM ft UNION ALL SELECT 'feature', feature, feature FROM ft UNION ALL SELECT 'owner', owner, owner FROM ft)),
rf AS (SELECT r.*, e.key IS NOT NULL AS resolved FROM (SELECT {_KIND.format('src')} AS from_kind, src AS from_key, {_KIND.format('dst')} AS to_kind, dst AS to_key FROM edges WHERE kind = 'imports' AND dst NOT LIKE 'external:%' UNION SELECT 'feature', feature, {_KIND.format('path')}, path FROM ft
 UNION SELECT 'feature', feature, 'endpoint', endpoint FROM ft UNION SELECT 'feature', feature, 'table', tbl FROM ft UNION SELECT 'owner', owner, {_KIND.format('path')}, path FROM ft) r LEFT JOIN ent e ON e.kind = r.to_kind AND e.key = r.to_key)"""
ORACLES = {
    "domain_index_summary": f"""{_INDEX} SELECT kind, entities, coalesce(outgoing, 0) AS outgoing, coalesce(unresolved, 0) AS unresolved, coalesce(alone, 0) AS unreferenced FROM (SELECT kind, count(*) AS entities FROM ent GROUP BY kind)
LEFT JOIN (SELECT from_kind AS kind, count(*) AS outgoing, count(*) FILTER (NOT resolved) AS unresolved FROM rf GROUP BY 1) USING (kind) LEFT JOIN (SELECT kind, count(*) AS alone FROM ent WHERE (kind, key) NOT IN (SELECT (to_kind, to_key) FROM rf WHERE resolved) GROUP BY kind) USING (kind)""",
    "domain_slice": f"""{_INDEX}, b AS (SELECT from_kind AS ak, from_key AS a, to_kind AS bk, to_key AS b FROM rf WHERE resolved AND from_kind <> 'owner' UNION SELECT to_kind, to_key, from_kind, from_key FROM rf WHERE resolved AND from_kind <> 'owner'),
l0 AS (SELECT kind, key, 0::BIGINT AS hops FROM ent WHERE kind = 'feature' AND key IN ('size7', 'size8')), l1 AS (SELECT DISTINCT bk AS kind, b AS key, 1::BIGINT AS hops FROM b JOIN l0 ON ak = kind AND a = key), l2 AS (SELECT DISTINCT bk AS kind, b AS key, 2::BIGINT AS hops FROM b JOIN l1 ON ak = kind AND a = key)
SELECT kind, key, name, min(hops) AS hops FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) JOIN ent USING (kind, key) GROUP BY ALL""",
}
