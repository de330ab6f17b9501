"""Parsers and checks whose inputs are texts and plans drawn from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import graph as G
from ..sources import parsers as S
from ..sources.tables import table

# Texts in the SQL that both engines read; {part} and {pages} name the tables.
_HAR = """SELECT page_id, '{{"log":{{"entries":[{{"request":{{"method":"' || CASE page_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' ELSE 'put' END || '","url":"' || url || '"}},"response":{{"status":' || (page_id % 4 + 2) * 100 || '}}}},{{"request":{{"method":"GET","url":"ftp://x/' || page_id || '"}},"response":{{"status":200}}}}]}}}}' AS har FROM {pages}"""
_SPEC = """SELECT k, '{{"paths":{{"/' || w || '/' || k || '":{{"get":{{"operationId":"all' || k || '","parameters":[{{"name":"' || w || '","in":"query"}},{{"name":"id","in":"path"}},{{"name":"limit","in":"query"}}]}}' || CASE WHEN s % 2 = 0 THEN ',"post":{{}}' ELSE '' END || '}}}}}}' AS spec
 FROM (SELECT p_partkey AS k, p_size AS s, lower(split_part(p_name, ' ', 1)) AS w FROM {part}) p"""
_OUTPUT = """SELECT k, 'building' || chr(10) || CASE s % 4 WHEN 0 THEN 'src/m' || k || '.ts(' || s || ',' || (k % 80 + 1) || '): error TS' || (2000 + s) || ': wrong type' WHEN 1 THEN ' FAIL  tests/m' || k || '.test.ts' WHEN 2 THEN 'lib/m' || k || '.py:' || (k % 900 + 1) || ':' || s || ' late name' ELSE 'ok ' || k END || chr(10) || 'done in ' || s AS text
 FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) p"""
_LOCK = """SELECT k, '{{"packages":{{"":{{}},"node_modules/lib' || (k % 97) || '":{{"version":"' || s || '"' || CASE s % 4 WHEN 0 THEN '' WHEN 1 THEN ',"license":"MIT"' WHEN 2 THEN ',"license":"ISC"' ELSE ',"license":"' || b || '"' END || '}},"node_modules/a/node_modules/deep' || (k % 53) || '":{{"license":"MIT"}}}}}}' AS lock
 FROM (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM {part}) p"""
#: Three statements a table, whose name is its number in letters.
_DDL = """SELECT k * 3 + n AS ord, CASE n WHEN 0 THEN 'CREATE TABLE ' || t || ' (id int, ' || CASE s % 2 WHEN 0 THEN 'price decimal(10, 2)' ELSE 'note text, kind text' END || ')' WHEN 1 THEN CASE WHEN s % 3 = 0 THEN 'ALTER TABLE ' || t || ' ADD COLUMN owner text' ELSE 'CREATE INDEX by_id_' || t || ' ON ' || t || ' (id)' END
 ELSE CASE WHEN s % 5 = 0 THEN 'create unique index only_' || t || ' on ' || t || ' (id)' ELSE 'select 1 on ' || t END END AS sql
 FROM (SELECT p_partkey AS k, p_size AS s, 't_' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') AS t FROM {part}) p CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) v"""
#: In blocks of eight, half of them chains with some links missing, half of them tasks that write one path of two.
_TASKS = """SELECT 'task' || k AS task, CAST(k AS INT) AS ord, CASE WHEN k div 8 % 2 = 0 AND k % 8 > 0 AND s % 3 > 0 THEN 'task' || (k - 1) END AS dep, CASE WHEN k div 8 % 2 = 0 THEN 'own' || k ELSE 'block' || (k div 8) || '/' || (s % 2) END AS path FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) p"""
_PROPOSALS = """SELECT 'p' || k AS id, k AS ord, 'b' || (k div 6) || '/' || (s % 3) AS reads, 'b' || (k div 6) || '/' || (s % 4) AS writes FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) p"""
_RING = """SELECT k AS src, k div 10 * 10 + (k % 10 * 3 + s) % 10 AS dst FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) p"""
_RULES = """SELECT 'packages/' || b || CASE s % 2 WHEN 0 THEN '/** ' ELSE ' ' END || '@' || lower(b) || s || CASE WHEN s % 3 = 0 THEN ' @all # and others' ELSE '' END AS text FROM (SELECT DISTINCT replace(p_brand, '#', '') AS b, p_size AS s FROM {part}) p"""


def made(spark: SparkSession, d: str, text: str) -> DataFrame:
    names = [n for n in ("part", "pages") if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, d, n) for n in names})


def duck(text: str) -> str:
    for n in ("part", "pages"):
        text = text.replace("{" + n + "}", n)
    return text.replace("{{", "{").replace("}}", "}").replace("AS STRING", "AS VARCHAR").replace(" div ", " // ")


def ddl(spark, d):
    return D.ddl_fold(made(spark, d, _DDL))


def waves(spark, d):
    t = made(spark, d, _TASKS).select("task", "ord", F.array_compact(F.array("dep")).alias("deps"), F.array("path").alias("writes"))
    return D.waves(t).select("task", F.col("wave").cast("long").alias("wave"))


def coverage(spark, d):
    """Mean sizes of brands on even and on odd keys, as metrics before and after."""
    p = table(spark, d, "part").withColumn("metric", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")))
    side = lambda odd: p.where(F.col("p_partkey") % 2 == odd).groupBy("metric").agg(F.avg(F.col("p_partkey") % 100).alias("value"))
    return D.coverage_delta(side(0), side(1))


def conflicts(spark, d):
    return D.pair_conflicts(made(spark, d, _PROPOSALS).select("id", "ord", F.array("reads").alias("reads"), F.array("writes").alias("writes")))


def licences(spark, d):
    direct = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("lib"), (F.col("p_partkey") % 97).cast("string")).alias("name"))
    return S.licences(made(spark, d, _LOCK), direct)


def owners(spark, d):
    """Owners of one path in each brand's package and of one outside."""
    p = table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "").alias("b"), "p_partkey")
    paths = p.select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("other/"), "b")).otherwise(F.concat(F.lit("packages/"), "b", F.lit("/src/m"), (F.col("p_partkey") % 50).cast("string"), F.lit(".ts"))).alias("path")).distinct()
    return S.owners(made(spark, d, _RULES), paths)


QUERIES = {
    "domain_ddl_fold": ddl, "schedule_waves": waves, "check_coverage_delta": coverage, "reconcile_conflicts": conflicts, "source_licences": licences, "source_owners_of_packages": owners,
    "graph_scc": lambda s, d: G.strongly_connected(made(s, d, _RING)),
    "source_har_import": lambda s, d: S.har(made(s, d, _HAR)),
    "source_openapi_import": lambda s, d: S.openapi(made(s, d, _SPEC)),
    "source_diagnostics": lambda s, d: S.diagnostics(made(s, d, _OUTPUT)),
}
_SEG = "CASE WHEN regexp_matches(s, '^[0-9]+$') OR (length(s) >= 18 AND regexp_matches(s, '^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$')) THEN '{id}' ELSE s END"
ORACLES = {
    "domain_ddl_fold": "SELECT 't_' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS name, 'id,' || CASE p_size % 2 WHEN 0 THEN 'price' ELSE 'note,kind' END || CASE WHEN p_size % 3 = 0 THEN ',owner' ELSE '' END AS columns, array_to_string(list_filter([CASE WHEN p_size % 3 <> 0 THEN 'by_id_' || 't_' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') END, CASE WHEN p_size % 5 = 0 THEN 'only_' || 't_' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') END], lambda x: x IS NOT NULL), ',') AS indexes FROM part",
    "schedule_waves": f"""WITH t AS ({duck(_TASKS)}), c AS (SELECT *, ord // 8 AS block, count(*) FILTER (dep IS NULL) OVER (PARTITION BY ord // 8 ORDER BY ord) AS run FROM t)
SELECT task, CASE WHEN block % 2 = 0 THEN row_number() OVER (PARTITION BY block, run ORDER BY ord) - 1 ELSE row_number() OVER (PARTITION BY path ORDER BY ord) - 1 END AS wave FROM c""",
    "check_coverage_delta": """WITH p AS (SELECT p_brand || '/' || p_size AS metric, p_partkey FROM part), b AS (SELECT metric, avg(p_partkey % 100) AS b FROM p WHERE p_partkey % 2 = 0 GROUP BY metric), a AS (SELECT metric, avg(p_partkey % 100) AS a FROM p WHERE p_partkey % 2 = 1 GROUP BY metric)
SELECT coalesce(a.metric, b.metric) AS metric, round(a - b, 2) AS delta, CASE WHEN a - b IS NULL THEN 'warn' WHEN round(a - b, 2) < -0.5 THEN 'fail' ELSE 'pass' END AS status FROM b FULL OUTER JOIN a ON a.metric = b.metric""",
    "reconcile_conflicts": f"""WITH p AS ({duck(_PROPOSALS)}), t AS (SELECT id, ord, path, bool_or(w) AS w FROM (SELECT id, ord, reads AS path, false AS w FROM p UNION ALL SELECT id, ord, writes, true FROM p) GROUP BY ALL)
SELECT x.id AS a, y.id AS b, x.path, CASE WHEN x.w AND y.w THEN 'write_write' ELSE 'read_write' END AS kind FROM t x JOIN t y ON x.path = y.path AND x.ord < y.ord AND (x.w OR y.w)""",
    "source_licences": """WITH l AS (SELECT DISTINCT 'lib' || p_partkey % 97 AS name, CASE p_size % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'MIT' WHEN 2 THEN 'ISC' ELSE p_brand END AS license FROM part UNION SELECT 'deep' || p_partkey % 53, 'MIT' FROM part)
SELECT license, count(*) AS packages, count(*) FILTER (name IN (SELECT 'lib' || p_partkey % 97 FROM part WHERE p_size = 1)) AS direct FROM l GROUP BY license""",
    "source_owners_of_packages": """WITH r AS (SELECT DISTINCT replace(p_brand, '#', '') AS b, p_size AS s FROM part), w AS (SELECT b, '@' || lower(b) || s AS who FROM r UNION SELECT b, '@all' FROM r WHERE s % 3 = 0),
f AS (SELECT DISTINCT replace(p_brand, '#', '') AS b, CASE WHEN p_partkey % 7 = 0 THEN 'other/' || replace(p_brand, '#', '') ELSE 'packages/' || replace(p_brand, '#', '') || '/src/m' || p_partkey % 50 || '.ts' END AS path FROM part)
SELECT path, coalesce(CASE WHEN path LIKE 'packages/%' THEN string_agg(DISTINCT who, ',' ORDER BY who) END, '') AS owners FROM f LEFT JOIN w USING (b) GROUP BY path""",
    "graph_scc": f"""WITH RECURSIVE e AS (SELECT * FROM ({duck(_RING)}) WHERE dst IN (SELECT p_partkey FROM part)), w AS (SELECT src AS node, dst AS tip, 1 AS n FROM e WHERE src <> dst UNION ALL SELECT node, dst, n + 1 FROM w JOIN e ON src = tip WHERE n < 12),
c AS (SELECT node FROM w WHERE tip = node AND n > 1) SELECT c.node, least(c.node, min(w.tip)) AS scc FROM (SELECT DISTINCT node FROM c) c JOIN w ON w.node = c.node GROUP BY c.node""",
    "source_har_import": f"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin, array_to_string(list_transform(str_split(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '/'), lambda s: {_SEG}), '/') AS path_template,
 list_sort(list_distinct(list_filter(list_transform(str_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: str_split(p, '=')[1]), lambda k: k <> ''))) AS keys FROM pages WHERE regexp_matches(url, '^https?://'))
SELECT CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, origin, path_template, array_to_string(keys, ',') AS query_keys, (page_id % 4 + 2) || 'xx' AS status_class FROM u""",
    "source_openapi_import": """WITH p AS (SELECT p_partkey AS k, p_size AS s, lower(split_part(p_name, ' ', 1)) AS w FROM part)
SELECT '/' || w || '/' || k AS path, 'GET' AS method, 'all' || k AS operation_id, array_to_string(list_sort([w, 'limit']), ',') AS query_keys FROM p UNION ALL SELECT '/' || w || '/' || k, 'POST', NULL, '' FROM p WHERE s % 2 = 0""",
    "source_diagnostics": f"""WITH o AS ({duck(_OUTPUT)}), l AS (SELECT k, p_size AS s FROM o JOIN part ON k = p_partkey)
SELECT 2::BIGINT AS "at", CASE s % 4 WHEN 0 THEN 'src/m' || k || '.ts' WHEN 1 THEN 'tests/m' || k || '.test.ts' ELSE 'lib/m' || k || '.py' END AS file, CASE s % 4 WHEN 0 THEN s::INT WHEN 1 THEN NULL ELSE (k % 900 + 1)::INT END AS line, CASE s % 4 WHEN 0 THEN 'TS' || (2000 + s) WHEN 1 THEN 'FAIL' ELSE 'message' END AS code FROM l WHERE s % 4 < 3""",
}
