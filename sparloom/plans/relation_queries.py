"""Scored paths, impact of a change by its hunks, and blast radius, over the fact graph of the source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as L
from ..operators import repo as R
from ..sources import parsers as S
from ..sources.tables import table
from . import repo_queries as Q

DEPTH = 3
#: Diffs of the changed files: two hunks each, the second without lines, where their size is even; none else.
_DIFF = r"""SELECT k, CASE WHEN s % 2 = 0 THEN 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || (s % 4 + 1) || ',2 +' || (s % 5 + 1) || ',' || (s % 3) || ' @@ x' || chr(10) || '+a' || chr(10) || '@@ -20 +' || (s % 3 + 8) || ' @@' ELSE 'no diff of ' || path END AS diff
 FROM (SELECT {PATH} AS path, k, s FROM (SELECT p_partkey AS k, p_size AS s FROM {T}) p) WHERE {CH}"""


def _text(t: str) -> str:
    return _DIFF.replace("{PATH}", Q._PATH).replace("{CH}", Q._CHANGED).replace("{T}", t)


def diffs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_text("{part}"), part=table(spark, d, "part"))


def hunks(spark: SparkSession, d: str) -> DataFrame:
    return S.diff_hunks(diffs(spark, d), "k", "diff")


def provenance(kind: Column) -> Column:
    return F.when(kind == "calls", "inferred").when(kind == "references", "derived").otherwise("extracted")


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, _, edges = Q._graph(spark, d)
    return f, edges.withColumn("provenance", provenance(F.col("kind")))


def scored_paths(spark, d):
    """From tests and guides to core files and their functions, either way along the edges."""
    _, edges = _facts(spark, d)
    inner = edges.where("NOT startswith(dst, 'external:')")
    nodes = inner.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    start = nodes.where("(node LIKE 'tests/%2.test.ts' OR node LIKE 'docs/%9.md') AND NOT contains(node, '#')")
    return L.paths(inner, start, nodes.where("node LIKE 'src/core/%' AND NOT contains(node, '#C')"), DEPTH, "both", ["imports", "references", "calls", "defines"], 100)


def changed_symbols(spark, d):
    """Symbols on changed lines; all symbols of changed files without hunks."""
    return L.changed_symbols(R.symbols(Q.files(spark, d)), Q.changed(spark, d), hunks(spark, d)).select("id", "kind", "line")


def deep_impact(spark, d):
    f, edges = _facts(spark, d)
    return L.impact(f, R.symbols(f), edges, Q.changed(spark, d), hunks(spark, d), DEPTH)


def impact_risk(spark, d):
    return L.risk(deep_impact(spark, d))


def blast_radius(spark, d):
    """What hangs on the core files whose number ends in 4."""
    f, edges = _facts(spark, d)
    return L.blast_radius(edges, f.where("path LIKE 'src/core/%4.ts'").select(F.col("path").alias("node")), DEPTH)


QUERIES = {
    "source_diff_hunks": hunks, "impact_interval_hunks": changed_symbols, "relation_scored_paths": scored_paths, "impact_change_depth": deep_impact, "impact_risk": impact_risk, "impact_blast_facts": blast_radius,
}
_GROUP = lambda g: f"regexp_extract(l, '^@@ -(\\d+)(,(\\d+))? [+](\\d+)(,(\\d+))? @@', {g})"
_HUNK = f"""diffs AS ({_text('part')}), hunk AS (SELECT k, file, a[1]::INT AS old_start, CASE WHEN a[2] = '' THEN 1 ELSE a[2]::INT END AS old_lines, a[3]::INT AS new_start, CASE WHEN a[4] = '' THEN 1 ELSE a[4]::INT END AS new_lines FROM (
 SELECT k, regexp_extract(diff, '[+][+][+] b/([^ \\n]+)', 1) AS file, [{', '.join(_GROUP(g) for g in (1, 3, 4, 6))}] AS a FROM (SELECT k, diff, unnest(str_split(diff, chr(10))) AS l FROM diffs) WHERE l LIKE '@@ -%'))"""
_OWN = """own_ AS (SELECT s.* FROM sym s JOIN ch USING (path) WHERE path NOT IN (SELECT file FROM hunk) OR EXISTS (SELECT 1 FROM hunk h WHERE h.file = s.path AND s.line >= h.new_start AND s.line <= h.new_start + greatest(1, h.new_lines) - 1))"""
_STEP = "src || ' -' || kind || '-> ' || dst"
_W = "CASE kind WHEN 'calls' THEN 0.6 WHEN 'references' THEN 0.8 ELSE 1.0 END::DOUBLE"
_REC = Q._EDGES.replace("WITH ", "WITH RECURSIVE ", 1)


def _walk(starts: str, where: str, by_start: bool, inbound_only: bool) -> str:
    """All walks level by level, keeping the first route of each node (and start) on the level where it is reached."""
    steps = f"SELECT dst AS a, src AS b, {_STEP} AS step, {_W} AS w, confidence, kind = 'calls' AS inf FROM edges WHERE {where} AND src <> dst"
    if not inbound_only:
        steps += f" UNION ALL SELECT src, dst, {_STEP}, {_W}, confidence, kind = 'calls' FROM edges WHERE {where} AND src <> dst"
    key = "st, node" if by_start else "node"
    out = [f"st AS ({steps})", f"l0 AS MATERIALIZED (SELECT DISTINCT {'node' if by_start else 'NULL'} AS st, node, 0 AS hops, []::VARCHAR[] AS route, 0.0::DOUBLE AS w, 1.0::DOUBLE AS sure, false AS inf FROM ({starts}))"]
    for k in range(1, DEPTH + 1):
        before = " UNION ALL ".join(f"SELECT {key} FROM l{j}" for j in range(k))
        near = f"SELECT l.st, s.b AS node, {k} AS hops, list_append(l.route, s.step) AS route, l.w + s.w AS w, CASE WHEN l.hops = 0 THEN s.confidence ELSE l.sure END AS sure, CASE WHEN l.hops = 0 THEN s.inf ELSE l.inf END AS inf FROM l{k - 1} l JOIN st s ON s.a = l.node"
        gone = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in key.split(", "))
        out.append(f"l{k} AS MATERIALIZED (SELECT * FROM ({near}) n WHERE NOT EXISTS (SELECT 1 FROM ({before}) g WHERE {gone}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY route, w, sure, inf) = 1)")
    return ", ".join(out) + ", reach AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, DEPTH + 1)) + ")"


_CARRY = "kind IN ('imports', 'references', 'calls', 'tests')"
_IMPACT = f"""{_REC}, {Q._CH}, {_HUNK}, {_OWN}, tst AS (SELECT test, max(c) AS confidence FROM (SELECT path AS test, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS word FROM files WHERE path LIKE 'tests/%') w
 JOIN (SELECT name AS word, 0.85::DOUBLE AS c FROM own_ UNION ALL SELECT regexp_extract(path, '(m[0-9]+)[.]', 1), 0.75 FROM ch) x USING (word) GROUP BY test),
{_walk('SELECT path AS node FROM ch UNION SELECT id FROM own_', _CARRY, False, True)},
found AS (SELECT CASE WHEN path LIKE 'tests/%' THEN 'test' ELSE 'file' END AS kind, path AS node, hops, CASE WHEN path LIKE 'tests/%' THEN 0.95 WHEN hops = 1 THEN CASE WHEN inf THEN 0.6 ELSE sure END ELSE greatest(0.6, round(w / hops / hops, 4)) END::DOUBLE AS confidence, array_to_string(route, ' | ') AS route
 FROM (SELECT *, str_split(node, '#')[1] AS path FROM reach) WHERE path NOT IN (SELECT path FROM ch) UNION ALL SELECT 'test', test, NULL, confidence, '' FROM tst WHERE test NOT IN (SELECT path FROM ch)),
whole AS (SELECT 'symbol' AS kind, id AS node, 0 AS hops, 1.0::DOUBLE AS confidence, '' AS route FROM own_ UNION ALL SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY kind, node ORDER BY confidence DESC, coalesce(hops, 99), route) = 1)"""
_MODULE = "CASE WHEN path NOT LIKE '%/%' THEN '.' WHEN path LIKE 'src/%/%' THEN 'src/' || str_split(path, '/')[2] ELSE str_split(path, '/')[1] END"
ORACLES = {
    "source_diff_hunks": f"WITH {_HUNK} SELECT * FROM hunk",
    "impact_interval_hunks": f"WITH {Q._F}, {Q._SYM}, {Q._CH}, {_HUNK}, {_OWN} SELECT id, kind, line FROM own_",
    "relation_scored_paths": f"""{_REC}, ends AS (SELECT src AS node FROM edges WHERE dst NOT LIKE 'external:%' UNION SELECT dst FROM edges WHERE dst NOT LIKE 'external:%'),
{_walk("SELECT node FROM ends WHERE (node LIKE 'tests/%2.test.ts' OR node LIKE 'docs/%9.md') AND NOT contains(node, '#')", "dst NOT LIKE 'external:%'", True, False)}
SELECT st AS start, node AS goal, hops, round(w / hops / hops, 4) AS score, array_to_string(route, ' | ') AS route FROM reach WHERE node LIKE 'src/core/%' AND NOT contains(node, '#C') ORDER BY score DESC, hops, start, goal LIMIT 100""",
    "impact_change_depth": f"{_IMPACT} SELECT * FROM whole",
    "impact_risk": f"{_IMPACT} SELECT f AS files, t AS tests, CASE WHEN t = 0 OR f > 5 THEN 'high' WHEN f > 0 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT count(*) FILTER (kind = 'file') AS f, count(*) FILTER (kind = 'test') AS t FROM whole)",
    "impact_blast_facts": f"""{_REC}, {_walk("SELECT path AS node FROM files WHERE path LIKE 'src/core/%4.ts'", _CARRY, False, True)},
r AS (SELECT path, min(hops) AS hops, count(*) AS n FROM (SELECT *, str_split(node, '#')[1] AS path FROM reach) WHERE path NOT LIKE 'src/core/%4.ts' GROUP BY path)
SELECT CASE WHEN path LIKE 'tests/%' THEN 'test' ELSE 'file' END AS kind, path AS name, hops, n FROM r UNION ALL SELECT 'entrypoint', path, hops, n FROM r WHERE path NOT LIKE 'tests/%' AND path NOT IN (SELECT dst FROM edges WHERE kind = 'imports')
UNION ALL SELECT 'module', {_MODULE}, min(hops), sum(n)::BIGINT FROM r GROUP BY 2""",
}
