"""Walks, slices, reach, routes, audits and tool search, bound to the generated source files and to rows of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore as E
from ..sources.tables import table
from . import repo_queries as R

_SERVERS = """SELECT 'srv/m' || k || '.ts' AS path, CASE k % 3
 WHEN 0 THEN 'import child from "./m' || (k + 1) || '";' || chr(10) || 'import { other as alias } from "./m' || (k + 2) || '";' || chr(10) || 'app.use("/v' || k || '/", child);' || chr(10)
  || 'fastify.register(alias, { prefix: "p' || k || '" });' || chr(10) || 'app.get("/health' || k || '", x);' || CASE WHEN s % 2 = 0 THEN ' const jwt = 1;' ELSE '' END
 WHEN 1 THEN 'router.get("/", f); Router.POST("items", f); ' || CASE WHEN s % 5 = 0 THEN 'session()' ELSE '' END
 ELSE 'server.route({ method: ["GET", "put"], url: "/things/:id", f });' || chr(10) || 'router.delete("/x' || k || '", f);' || CASE WHEN s % 2 = 1 THEN ' preHandler' ELSE '' END END AS content
 FROM (SELECT p_partkey AS k, p_size AS s FROM part) p"""
_AUDITS = """SELECT k AS id, CASE k % 3
 WHEN 0 THEN '{"vulnerabilities":{"pkg' || k || '":{"severity":"' || CASE k % 2 WHEN 0 THEN 'high' ELSE 'odd' END || '","range":"<' || k || '","via":["x",{"title":"T' || k || '","name":"CVE-2024-' || (1000 + k) || '"}],"fixAvailable":' || CASE WHEN s % 2 = 0 THEN '{"version":"' || k || '.0.0"}' ELSE 'false' END || '}}}'
 WHEN 1 THEN '{"advisories":{"7":{"module_name":"adv' || k || '","severity":"moderate","vulnerable_versions":"*","patched_versions":"' || CASE WHEN s % 2 = 0 THEN '<0.0.0' ELSE '>=2' END || '","title":"A","url":"https://x.example/GHSA-aaaa-bbbb-cccc","cves":["cve-2023-' || (1000 + k) || '"]}}}'
 ELSE '{"top' || k || '":[{"severity":"low","title":"B","name":"CVE-2022-1"},{"severity":"critical","url":"u"}],"vulnerabilities":{}}' END AS audit FROM (SELECT p_partkey AS k, p_size AS s FROM part) p"""
_ENTRIES = """SELECT k, CASE k % 8 WHEN 0 THEN 'src/api/r' || k || '.ts' WHEN 1 THEN 'src/cli.ts' WHEN 2 THEN 'tools/commands/c.js' WHEN 3 THEN 'src/jobs/j.ts' WHEN 4 THEN 'src/mail-queue.ts' ELSE 'lib/a.ts' END AS path,
 CASE k % 8 WHEN 5 THEN 'router.post( x' WHEN 6 THEN '#!/usr/bin/env node' WHEN 7 THEN CASE WHEN s % 2 = 0 THEN 'processJob (x)' ELSE 'none' END ELSE '' END AS content FROM (SELECT p_partkey AS k, p_size AS s FROM part) p"""
_NUMBER = "CAST(regexp_extract(path, '([0-9]+)[.]', 1) AS INT)"
_MORE = f"""CASE WHEN path LIKE 'lib/%' AND {_NUMBER} % 24 = 6 THEN chr(10) || 'import("../packages/p3/src/" + x)' WHEN path LIKE 'tests/%' AND {_NUMBER} % 16 = 4 THEN chr(10) || 'router.get( x'
 WHEN path LIKE 'src/core/%' AND {_NUMBER} % 16 = 12 THEN chr(10) || 'new WebSocket(x)' ELSE '' END"""
_ENTRY, _USED = f"path LIKE 'packages/%' AND {_NUMBER} < 300", f"{_NUMBER} % 29 = 0"
_COMMUNITY = "regexp_extract(path, '^(packages/p[0-9]+|src/core|tests|lib|docs)', 1)"


def _made(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM part)", "FROM {part})"), part=table(spark, d, "part"))


def _imports(spark, d):
    return R._graph(spark, d)[2].where("kind = 'imports' AND NOT startswith(dst, 'external:')")


def affected(spark, d):
    return E.affected(_imports(spark, d), R.changed(spark, d).select(F.col("path").alias("node")))


def metrics(spark, d):
    f, _, edges = R._graph(spark, d)
    return E.metrics(f.select(F.col("path").alias("node")), edges.where("kind = 'imports'"))


def slices(spark, d):
    f, _, edges = R._graph(spark, d)
    return E.slices(edges, f.select(F.col("path").alias("file"), F.expr(_COMMUNITY).alias("community")))


def explained(spark, d):
    return E.explained(R._graph(spark, d)[2], R.changed(spark, d).select(F.col("path").alias("node")), 5).withColumn("nth", F.col("nth").cast("long"))


def file_classes(spark, d):
    f, _, edges = R._graph(spark, d)
    f = f.withColumn("content", F.concat("content", F.expr(_MORE)))
    return E.file_classes(f, edges, f.where(_ENTRY).select("path"), f.where(_USED).select("path"))


def stale(spark, d):
    records = R.files(spark, d).select(F.col("path").alias("record"), F.expr(f"CASE WHEN {_NUMBER} % 3 = 0 THEN 'url' ELSE 'file' END").alias("kind"), F.col("path").alias("source"))
    return E.stale_evidence(records, R.changed(spark, d), R.impact(spark, d).where("kind = 'file'").select(F.col("node").alias("path")))


def audit_counts(spark, d):
    """How many findings each severity has, the most severe first (CHK-07)."""
    n = E.audit(_made(spark, d, _AUDITS)).groupBy("severity").agg(F.count("*").alias("n"), F.count_if("fixable").alias("fixable"))
    return E.by_severity(n)


def compaction(spark, d):
    item = lambda i: F.concat(F.lit('{"i":'), i.cast("string"), F.lit(', "m":"'), F.when((i + F.col("k")) % 4 == 0, "Failed").otherwise("ok"), F.lit('"}'))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumn("c", F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k") % 9 + 1), item), ", "), F.lit("]")))
    return t.select("k", E.compacted_json(F.when(F.col("k") % 10 == 0, '{ "a" : 1, "b" : [1, 2] }').otherwise(F.col("c"))).alias("j")).select("k", "j.kept", F.col("j.dropped").cast("long").alias("dropped"))


def _tool(k: int) -> str:
    return (f"repo-search-{k}", f"indexStatus{k}", f"file_read_{k}", f"map{k}")[k % 4]


def tools(spark, d):
    """Tools made of parts; those of the first 150 keys are allowed, and of the first five to begin with."""
    k, s, text = F.col("k"), F.col("s"), F.col("k").cast("string")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    t = t.select(
        F.when(k % 4 == 0, F.concat(F.lit("repo-search-"), text)).when(k % 4 == 1, F.concat(F.lit("indexStatus"), text)).when(k % 4 == 2, F.concat(F.lit("file_read_"), text)).otherwise(F.concat(F.lit("map"), text)).alias("name"),
        F.when(s % 3 == 0, "reader of the index").when(s % 3 == 1, "Search, repo-search style").otherwise("none").alias("summary"),
        F.when(s % 2 == 0, F.array(F.lit("file"))).otherwise(F.array(F.lit("none"))).alias("inputs"),
        F.when(k % 5 == 0, F.array(F.lit("repo-search"), F.lit("x"))).otherwise(F.array(F.lit("plain"))).alias("metadata"), k.alias("ord"),
    )
    return E.tool_search(t, "repo-search index file reader", [_tool(n) for n in range(1, 151)], [_tool(n) for n in range(1, 6)], 40)


_LEVEL = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'info' END"


def findings(spark, d):
    """The first and the last event of each user and type, by severity."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.expr(_LEVEL).alias("severity"))
    both = [E.one_of_each(e, ["user_id", "event_type"], "event_id", last).withColumn("which", F.lit("last" if last else "first")) for last in (False, True)]
    return E.by_severity(both[0].unionByName(both[1]), "user_id", "event_id")


def values(spark, d):
    tags = F.array(F.lit(" b"), F.lit("a"), F.lit("b "), F.lit(""), F.col("p_brand"), F.lit("a"))
    return table(spark, d, "part").select("p_partkey", F.array_join(E.unique_sorted(tags), "|").alias("sorted"), F.array_join(E.unique_in_order(tags), "|").alias("ordered"), F.round(E.recall(tags, F.array(F.lit("z"), F.lit("a"), F.col("p_brand"))), 4).alias("recall"))


def gate_plans(spark, d):
    e = lambda c: F.concat(F.lit("e"), c.cast("string"))
    gates = table(spark, d, "nation").select(F.col("n_name").alias("gate"), F.array(e(F.col("n_nationkey") % 5), e(F.col("n_regionkey") + 3)).alias("touches"))
    features = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feature"), F.array(e(F.col("s_suppkey") % 8), e(F.col("s_nationkey") % 7)).alias("effects"))
    return E.gate_plans(gates, features)


QUERIES = {
    "explore_affected": affected, "explore_metrics": metrics, "explore_slices": slices, "explore_node": explained,
    "explore_entrypoints": lambda s, d: _made(s, d, _ENTRIES).select("k", E.entrypoint_kind(F.col("path"), F.col("content")).alias("entry")),
    "explore_file_classes": file_classes, "explore_class_counts": lambda s, d: E.category_counts(file_classes(s, d)), "explore_stale_evidence": stale,
    "source_routes": lambda s, d: E.routes(_made(s, d, _SERVERS)), "source_audit": lambda s, d: E.audit(_made(s, d, _AUDITS)), "check_audit_counts": audit_counts,
    "text_json_compaction": compaction, "search_tools": tools, "set_findings": findings, "set_values": values, "domain_gate_plans": gate_plans,
}

_I = "i AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'imports' AND dst NOT LIKE 'external:%' AND src <> dst), e2 AS (SELECT src, dst FROM i UNION SELECT dst, src FROM i)"
_CLASSES = f"""WITH RECURSIVE {R._EDGES[5:]}, f2 AS (SELECT path, content || {_MORE} AS content, {_NUMBER} AS n FROM files), b AS (SELECT DISTINCT a, z FROM (SELECT {R._FILE.format('src')} AS a, {R._FILE.format('dst')} AS z FROM edges WHERE kind <> 'defines') WHERE a <> z),
w AS (SELECT path FROM files WHERE {_ENTRY} UNION SELECT b.z FROM w JOIN b ON b.a = w.path),
cl AS (SELECT path, CASE WHEN n % 29 = 0 THEN 95 WHEN content LIKE '%router.get(%' THEN 90 WHEN content LIKE '%WebSocket%' THEN 55 WHEN path IN (SELECT path FROM w) THEN 88 WHEN path IN (SELECT z FROM b) THEN 82 WHEN path LIKE 'packages/p3/src/%' AND (SELECT count(*) FROM f2 WHERE content LIKE '%import(%') > 0 THEN 50 ELSE 78 END AS c FROM f2 WHERE path LIKE '%.ts'),
classes AS (SELECT path, CASE WHEN c IN (95, 90, 88, 82) THEN 'likely_used' WHEN c = 78 THEN 'candidate_remove_pending_review' ELSE 'manual_review' END AS category, c / 100::DOUBLE AS confidence FROM cl)"""
_AUDIT = """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), found AS (
 SELECT k AS id, 'pkg' || k AS package, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'info' END AS severity, '<' || k AS range, 'T' || k AS title, 'CVE-2024-' || (1000 + k) AS identifiers, s % 2 = 0 AS fixable, CASE WHEN s % 2 = 0 THEN k || '.0.0' END AS fix_version FROM p WHERE k % 3 = 0
 UNION ALL SELECT k, 'adv' || k, 'moderate', '*', 'A', 'CVE-2023-' || (1000 + k) || ',GHSA-aaaa-bbbb-cccc', s % 2 <> 0, NULL FROM p WHERE k % 3 = 1
 UNION ALL SELECT k, 'top' || k, 'low', NULL, 'B', '', false, NULL FROM p WHERE k % 3 = 2 UNION ALL SELECT k, 'top' || k, 'critical', NULL, NULL, '', false, NULL FROM p WHERE k % 3 = 2)"""
_RANK = "CAST(list_position(['critical', 'high', 'moderate', 'medium', 'low', 'info'], severity) AS INT)"
ORACLES = {
    "explore_affected": f"WITH RECURSIVE {R._EDGES[5:]}, {R._CH}, {_I}, w AS (SELECT path AS start, path AS node FROM ch UNION SELECT w.start, e2.dst FROM w JOIN e2 ON e2.src = w.node) SELECT start AS node, count(*) - 1 AS reached FROM w GROUP BY start",
    "explore_metrics": f"""WITH RECURSIVE {R._EDGES[5:]}, {_I}, w AS (SELECT path AS start, path AS node FROM files UNION SELECT w.start, e2.dst FROM w JOIN e2 ON e2.src = w.node), near AS (SELECT src, dst FROM edges WHERE kind = 'imports' AND dst IN (SELECT path FROM files)),
deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM near UNION ALL SELECT dst FROM near) GROUP BY node ORDER BY d DESC, node LIMIT 10)
SELECT (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM near) AS edges, (SELECT count(*) FROM (SELECT start FROM w GROUP BY start HAVING min(node) = start)) AS components, (SELECT string_agg(node, ',' ORDER BY d DESC, node) FROM deg) AS top""",
    "explore_slices": f"""{R._EDGES}, m AS (SELECT path, {_COMMUNITY} AS community FROM files), x AS (SELECT src, dst, a.community AS ca, b.community AS cb FROM edges LEFT JOIN m a ON a.path = {R._FILE.format('src')} LEFT JOIN m b ON b.path = {R._FILE.format('dst')}),
near AS (SELECT DISTINCT community, node FROM (SELECT ca AS community, dst AS node FROM x WHERE ca IS DISTINCT FROM cb UNION ALL SELECT cb, src FROM x WHERE ca IS DISTINCT FROM cb) WHERE community IS NOT NULL)
SELECT c.community, (SELECT count(*) FROM x WHERE ca = c.community AND cb = c.community) AS internal, (SELECT count(*) FROM x WHERE cb = c.community AND ca IS DISTINCT FROM cb) AS incoming, (SELECT count(*) FROM x WHERE ca = c.community AND ca IS DISTINCT FROM cb) AS outgoing,
 coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT community, node FROM near QUALIFY row_number() OVER (PARTITION BY community ORDER BY node) <= 20) n WHERE n.community = c.community), '') AS neighbours FROM (SELECT DISTINCT community FROM m) c""",
    "explore_node": f"""{R._EDGES}, {R._CH}, x AS (SELECT src AS node, 'outbound' AS direction, dst AS other, kind, line FROM edges UNION ALL SELECT dst, 'inbound', src, kind, line FROM edges)
SELECT node, direction, nth, other, kind FROM (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY line, other, kind) AS nth FROM x WHERE node IN (SELECT path FROM ch)) WHERE nth <= 5""",
    "explore_entrypoints": "SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'api' WHEN 5 THEN 'api' WHEN 1 THEN 'cli' WHEN 2 THEN 'cli' WHEN 6 THEN 'cli' WHEN 7 THEN CASE WHEN p_size % 2 = 0 THEN 'worker' END ELSE 'worker' END AS entry FROM part",
    "explore_file_classes": f"{_CLASSES} SELECT * FROM classes",
    "explore_class_counts": f"{_CLASSES} SELECT " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in E.CATEGORIES) + " FROM classes",
    "explore_stale_evidence": f"{R._IMPACT} SELECT path AS record, path AS source, CASE WHEN path IN (SELECT path FROM ch) THEN 'changed' ELSE 'impacted' END AS reason FROM files WHERE {_NUMBER} % 3 <> 0 AND (path IN (SELECT path FROM ch) OR path IN (SELECT node FROM imp_all WHERE kind = 'file'))",
    "source_routes": """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), one AS (SELECT c.k, m.k AS up, c.s % 5 = 0 OR coalesce(m.s % 2 = 0, false) AS auth FROM p c LEFT JOIN p m ON m.k = c.k - 1 WHERE c.k % 3 = 1),
two AS (SELECT c.k, m.k AS up, c.s % 2 = 1 OR coalesce(m.s % 2 = 0, false) AS auth FROM p c LEFT JOIN p m ON m.k = c.k - 2 WHERE c.k % 3 = 2)
SELECT 'GET' AS method, '/health' || k AS path_template, 'srv/m' || k || '.ts' AS source_path, s % 2 = 0 AS auth_required FROM p WHERE k % 3 = 0
UNION ALL SELECT 'GET', coalesce('/v' || up || '/', '/'), 'srv/m' || k || '.ts', auth FROM one UNION ALL SELECT 'POST', coalesce('/v' || up || '/items', 'items'), 'srv/m' || k || '.ts', auth FROM one
UNION ALL SELECT unnest(['GET', 'PUT']), coalesce('/p' || up, '') || '/things/:id', 'srv/m' || k || '.ts', auth FROM two UNION ALL SELECT 'DELETE', coalesce('/p' || up, '') || '/x' || k, 'srv/m' || k || '.ts', auth FROM two""",
    "source_audit": f"{_AUDIT} SELECT * FROM found",
    "check_audit_counts": f"{_AUDIT} SELECT severity, count(*) AS n, count(*) FILTER (fixable) AS fixable, {_RANK} AS rank FROM found GROUP BY severity",
    "text_json_compaction": """WITH x AS (SELECT p_partkey AS k, p_partkey % 9 + 1 AS n, unnest(range(1, 10)) AS i FROM part),
kept AS (SELECT k, n, i, CASE WHEN i <= 2 THEN 0 WHEN (i + k) % 4 = 0 THEN 1 ELSE 2 END AS o FROM x WHERE i <= n AND (i <= 2 OR (i + k) % 4 = 0 OR i >= n - 1))
SELECT k, CASE WHEN k % 10 = 0 THEN '{"a":1,"b":[1,2]}' ELSE '[' || string_agg('{"i":' || i || ',"m":"' || CASE WHEN (i + k) % 4 = 0 THEN 'Failed' ELSE 'ok' END || '"}', ',' ORDER BY o, i) || ']' END AS kept, CASE WHEN k % 10 = 0 THEN 0 ELSE n - count(*) END AS dropped FROM kept GROUP BY k, n""",
    "search_tools": """SELECT name, CAST(pts + 25 + CASE WHEN k BETWEEN 1 AND 5 THEN 50 ELSE 0 END AS INT) AS score FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'repo-search-' WHEN 1 THEN 'indexStatus' WHEN 2 THEN 'file_read_' ELSE 'map' END || p_partkey AS name,
 CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE 0 END + CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 36 ELSE 0 END AS pts FROM part WHERE p_partkey BETWEEN 1 AND 150) WHERE pts > 0 ORDER BY score DESC, k LIMIT 40""",
    "set_findings": f"""SELECT user_id, event_type, event_id, severity, which, {_RANK} AS rank FROM (SELECT user_id, event_type, {_LEVEL} AS severity, min(event_id) AS event_id, 'first' AS which FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, {_LEVEL}, max(event_id), 'last' FROM events GROUP BY ALL)""",
    "set_values": "SELECT p_partkey, array_to_string(list_sort(list_distinct([' b', 'a', 'b ', '', p_brand])), '|') AS sorted, 'b|a|' || p_brand AS ordered, 0.6667::DOUBLE AS recall FROM part",
    "domain_gate_plans": "SELECT n_name AS gate, s_suppkey AS feature FROM nation, supplier WHERE n_nationkey % 5 IN (s_suppkey % 8, s_nationkey % 7) OR n_regionkey + 3 IN (s_suppkey % 8, s_nationkey % 7)",
}
