"""Source-file queries, bound to generated files: one for each row of ``part``, as TypeScript, tests, Python and
Markdown that import, call and link one another by key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repo as R
from ..sources import versions
from ..sources.tables import table
from ..storage import stored

_PATH = """CASE WHEN k % 8 < 4 THEN 'packages/p' || (k % 7) || '/src/m' || k || '.ts' WHEN k % 8 = 4 THEN 'src/core/m' || k || '.ts'
 WHEN k % 8 = 5 THEN 'tests/m' || (k - 1) || '.test.ts' WHEN k % 8 = 6 THEN 'lib/m' || k || '.py' ELSE 'docs/g' || k || '.md' END"""
_TEXT = """CASE WHEN k % 8 < 5 THEN
 CASE WHEN k % 6 = 0 THEN 'import ''../../../../gone'';' ELSE 'import { f' || (k - 56) || ' } from ''./m' || (k - 56) || ''';' END || chr(10)
 || 'import x from ''lib' || (k % 5) || ''';' || chr(10) || 'export function f' || k || '(a) {' || chr(10)
 || '  if (a && a.different) { return f' || (k - 56) || '(a) || helper(a); }' || chr(10)
 || CASE WHEN s % 4 = 0 THEN '  while (a) { for (;;) { f' || (k - 112) || '(a); } }' || chr(10) ELSE '' END
 || '  return a ? 1 : 2;' || chr(10) || '}' || chr(10) || 'export class C' || k || ' {}' || chr(10) || 'export const V' || k || ' = f' || k || '(1);' || chr(10)
 || CASE WHEN s % 3 = 0 THEN 'function helper(q) {' || chr(10) || '  return f' || k || '(q);' || chr(10) || '}' || chr(10) ELSE 'interface I' || k || ' { x: string }' || chr(10) END
 WHEN k % 8 = 5 THEN 'import { f' || (k - 1) || ' } from ''../src/core/m' || (k - 1) || ''';' || chr(10) || CASE WHEN s % 3 = 0 THEN 'test.skip(''x'', () => {});' WHEN s % 3 = 1 THEN 'test(''x'', () => { expect(f' || (k - 1) || '(1)).toBe(1); });' ELSE 'test(''x'', () => { expect(f' || (k - 1) || '(1)).toMatchSnapshot(); });' END
 WHEN k % 8 = 6 THEN 'from .m' || (k - 8) || ' import g' || (k - 8) || chr(10) || 'def g' || k || '(a):' || chr(10) || '    return g' || (k - 8) || '(a)' || chr(10) || 'class K' || k || ':' || chr(10) || '    pass'
 ELSE '# Guide ' || k || chr(10) || 'See [next](g' || (k - 8) || '.md) and [core](../src/core/m' || (k - 3) || '.ts).' || chr(10) || '## Use' END"""
_FILES = f"SELECT {_PATH} AS path, {_TEXT} AS content FROM (SELECT p_partkey AS k, p_size AS s FROM part) p"
#: Every tenth file counts as changed.
_CHANGED = "regexp_extract(path, '[0-9]+[.a-z]*$', 0) LIKE '%2.ts'"


#: Source files that one task makes and parses; ``part`` itself is so small that a few tasks would read it all.
FILES_A_TASK = 8192


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """What files are made of, dealt over tasks by its number of rows."""
    part, tasks = table(spark, d, "part").select("p_partkey", "p_size"), _tasks(spark, d)
    return part if tasks < 2 else part.repartition(tasks, "p_partkey")


def _tasks(spark: SparkSession, d: str) -> int:
    return math.ceil(table(spark, d, "part").count() / FILES_A_TASK)


def files(spark: SparkSession, d: str) -> DataFrame:
    text = _FILES.replace("{", "{{").replace("}", "}}").replace("FROM part)", "FROM {part})")
    return spark.sql(text, part=_dealt(spark, d))


def changed(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(_CHANGED).select("path")


_graphs: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {}


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, nodes and edges."""
    return _drawn(spark, d)[:3]


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, nodes, edges and symbols, drawn and written once for an application and folder of tables, and again where
    what was written is gone."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _graphs or not all(_there(spark, df) for df in _graphs[key]):
        f = stored(files(spark, d), "files")
        found = stored(R.symbols(f), "symbols")
        nodes, edges = R.fact_graph(f, found)
        _graphs[key] = (f, stored(nodes, "nodes"), stored(edges, "facts"), found)
    return _graphs[key]


def _there(spark: SparkSession, df: DataFrame) -> bool:
    fs, path = versions._files(spark, df.inputFiles()[0])
    return all(fs.exists(path(f)) for f in df.inputFiles())


def graph_edges(spark, d):
    return _graph(spark, d)[2].withColumn("line", F.col("line").cast("long"))


def graph_validation(spark, d):
    _, nodes, edges = _graph(spark, d)
    # two faults put in, so that there is something to find
    bad = edges.limit(0).unionByName(edges.sparkSession.createDataFrame([("src/none.ts", "src/nothing.ts", "imports", 1, 1.0), ("src/none.ts", "src/none.ts", "imports", 1, 1.0)], edges.schema))
    return R.validate(nodes, edges.unionByName(bad))


def disconnected(spark, d):
    f, _, edges = _graph(spark, d)
    return R.disconnected(f, edges)


def dead_code(spark, d):
    _, _, edges, found = _drawn(spark, d)
    return R.dead_code(found, edges, changed(spark, d))


def impact(spark, d):
    f, _, edges, found = _drawn(spark, d)
    return R.change_impact(f, found, edges, changed(spark, d))


def impact_summary(spark, d):
    """How much a change of each kind reaches, with a risk by reach (IMP-03)."""
    n = impact(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return n.withColumn("risk", F.when(F.col("n") > 100, "high").when(F.col("n") > 10, "medium").otherwise("low"))


def paths(spark, d):
    _, _, edges = _graph(spark, d)
    e = edges.where("kind = 'imports' AND NOT startswith(dst, 'external:')")
    start = files(spark, d).where("path LIKE 'tests/%' OR path LIKE 'docs/%'").select(F.col("path").alias("node"))
    out = R.shortest_paths(e, start.where("node LIKE '%9.md' OR node LIKE '%2.test.ts'"), 5)
    return out.select("node", "hops", F.array_join("route", " > ").alias("route"))


_LANG = "CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' ELSE 'markdown' END"
_F = f"files AS ({_FILES}), lines AS (SELECT path, content, language, u.i AS line, u.t AS t FROM (SELECT path, content, {_LANG} AS language, str_split(content, chr(10)) AS parts FROM files) f, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS t) u)"
_N = "[A-Za-z_$][A-Za-z0-9_$]*"
_SYM = f"""sym AS (SELECT path || '#' || name || ':' || line AS id, path, language, kind, name, line FROM (SELECT *, CASE kind
  WHEN 'function' THEN regexp_extract(t, '(function|def) +({_N})', 2) WHEN 'section' THEN regexp_extract(t, '^#+ +(.*)$', 1) ELSE regexp_extract(t, kw || ' +({_N})', 1) END AS name
 FROM (SELECT *, CASE WHEN language = 'markdown' THEN CASE WHEN t LIKE '#%' THEN 'section' END WHEN language = 'python' THEN CASE WHEN t LIKE 'def %' THEN 'function' WHEN t LIKE 'class %' THEN 'class' END
  WHEN regexp_matches(t, '^(export )?function ') THEN 'function' WHEN t LIKE 'export class %' THEN 'class' WHEN t LIKE 'interface %' THEN 'interface' WHEN t LIKE 'export const %' THEN 'constant' END AS kind,
  CASE WHEN t LIKE '%class %' THEN 'class' WHEN t LIKE 'interface %' THEN 'interface' ELSE 'const' END AS kw FROM lines)) WHERE kind IS NOT NULL)"""
_DR = """dr AS (SELECT path, line, unnest(list_distinct(CASE language WHEN 'typescript' THEN regexp_extract_all(t, '^import[^'']*''([^'']+)''', 1) WHEN 'python' THEN list_transform(regexp_extract_all(t, '^from [.]([a-z0-9_]+) ', 1), lambda x: './' || x) ELSE regexp_extract_all(t, '[(]([^)]+)[)]', 1) END)) AS specifier FROM lines)"""
_UP = "regexp_replace({}, '(^|/)[^/.]+/[.][.]/', '\\1')"
_IMP = f"""rel AS (SELECT path, line, specifier, {_UP.format(_UP.format(_UP.format(_UP.format("replace(regexp_replace(path, '[^/]*$', '') || specifier, '/./', '/')"))))} AS base FROM dr WHERE specifier LIKE '.%' OR specifier LIKE '%.md'),
imp AS (SELECT path, line, specifier, coalesce(a.p, b.p, c.p, e.p) AS target FROM rel LEFT JOIN (SELECT path AS p FROM files) a ON a.p = base LEFT JOIN (SELECT path AS p FROM files) b ON b.p = base || '.ts' LEFT JOIN (SELECT path AS p FROM files) c ON c.p = base || '.py' LEFT JOIN (SELECT path AS p FROM files) e ON e.p = base || '.md' WHERE coalesce(a.p, b.p, c.p, e.p) IS NOT NULL
 UNION ALL SELECT path, line, specifier, 'external:' || specifier FROM dr WHERE NOT (specifier LIKE '.%' OR specifier LIKE '%.md'))"""
_CALL = f"""own AS (SELECT l.path, l.line, l.t, s.id, s.kind, s.line AS top FROM lines l ASOF JOIN sym s ON l.path = s.path AND l.line >= s.line),
body AS (SELECT id, path, line, t FROM own WHERE kind = 'function' AND line > top),
said AS (SELECT id AS caller, path, name, min(line) AS line FROM (SELECT id, path, line, unnest(regexp_extract_all(t, '({_N}) *[(]', 1)) AS name FROM body) GROUP BY ALL),
fn AS (SELECT * FROM sym WHERE kind = 'function'),
call AS (SELECT caller, callee, line, CASE WHEN here THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM (SELECT s.caller, s.line, f.id AS callee, f.path = s.path AS here, row_number() OVER (PARTITION BY s.caller, s.name ORDER BY f.path = s.path DESC, f.path, f.line) AS k FROM said s JOIN fn f ON f.name = s.name) WHERE k = 1 AND caller <> callee)"""
_REF = """ref AS (SELECT n.path AS src, s.id AS dst, n.line FROM (SELECT path, line, trim(unnest(str_split(regexp_extract(t, '^import [{]([^}]*)[}]', 1), ','))) AS name FROM lines WHERE language = 'typescript') n JOIN imp i ON i.path = n.path AND i.line = n.line JOIN sym s ON s.path = i.target AND s.name = n.name)"""
_EDGES = f"""WITH {_F}, {_SYM}, {_DR}, {_IMP}, {_CALL}, {_REF}, edges AS (
 SELECT path AS src, id AS dst, 'defines' AS kind, line, 1.0::DOUBLE AS confidence FROM sym UNION ALL SELECT path, target, 'imports', min(line), 1.0 FROM imp GROUP BY path, target
 UNION ALL SELECT caller, callee, 'calls', line, confidence FROM call UNION ALL SELECT src, dst, 'references', line, 0.9 FROM ref)"""
_FILE = "CASE WHEN {0} LIKE 'external:%' THEN NULL ELSE str_split({0}, '#')[1] END"
_CH = f"ch AS (SELECT path FROM files WHERE {_CHANGED})"
_TESTS = """tst AS (SELECT test, max(c) AS confidence FROM (SELECT path AS test, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS word FROM files WHERE path LIKE 'tests/%') w
 JOIN (SELECT name AS word, 0.85::DOUBLE AS c FROM sym JOIN ch USING (path) UNION ALL SELECT regexp_extract(path, '(m[0-9]+)[.]', 1), 0.75 FROM ch) x USING (word) GROUP BY test)"""
_IMPACT = f"""{_EDGES}, {_CH}, {_TESTS}, into_ AS (SELECT {_FILE.format('src')} AS node, {_FILE.format('dst')} AS path, confidence FROM edges WHERE kind <> 'defines'),
imp_all AS (SELECT 'symbol' AS kind, id AS node, 1.0::DOUBLE AS confidence FROM sym JOIN ch USING (path)
 UNION ALL SELECT 'file', node, max(confidence) FROM into_ JOIN ch USING (path) WHERE node <> path AND node NOT IN (SELECT path FROM ch) AND node NOT LIKE 'tests/%' GROUP BY node
 UNION ALL SELECT 'test', test, confidence FROM tst WHERE test NOT IN (SELECT path FROM ch))"""
_COUNT = lambda branches: f"len(regexp_extract_all({branches}, '\\b(?:if|for|while|case|catch)\\b|&&|[|][|]|[?]'))"

QUERIES = {
    "repo_symbols": lambda s, d: R.symbols(files(s, d)),
    "repo_import_drafts": lambda s, d: R.import_drafts(files(s, d)),
    "repo_import_targets": lambda s, d: R.resolved_imports(R.import_drafts(files(s, d)), files(s, d)),
    "repo_body_extent": lambda s, d: R.bodies(R.symbols(files(s, d))).select("id", "line", "until"),
    "repo_calls": lambda s, d: R.calls(files(s, d), R.symbols(files(s, d))),
    "repo_complexity": lambda s, d: R.function_complexity(files(s, d), stored(R.symbols(files(s, d)), "symbols"), 4, _tasks(s, d)),
    "repo_fact_graph": graph_edges,
    "repo_graph_validation": graph_validation,
    "repo_disconnected_files": disconnected,
    "repo_dead_code": dead_code,
    "repo_tests_of_change": lambda s, d: R.tests_of(files(s, d), R.symbols(files(s, d)), changed(s, d)),
    "repo_change_impact": impact,
    "repo_impact_summary": impact_summary,
    "repo_shortest_paths": paths,
    "repo_parser_coverage": lambda s, d: R.parser_coverage(files(s, d), R.symbols(files(s, d))),
    "check_test_quality": lambda s, d: R.test_findings(files(s, d)),
}
ORACLES = {
    "repo_symbols": f"WITH {_F}, {_SYM} SELECT * FROM sym",
    "repo_import_drafts": f"WITH {_F}, {_DR} SELECT * FROM dr",
    "repo_import_targets": f"WITH {_F}, {_DR}, {_IMP} SELECT * FROM imp",
    "repo_body_extent": f"WITH {_F}, {_SYM} SELECT id, line, until FROM (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) AS until FROM sym) WHERE kind = 'function'",
    "repo_calls": f"WITH {_F}, {_SYM}, {_CALL} SELECT * FROM call",
    "repo_complexity": f"WITH {_F}, {_SYM}, {_CALL} SELECT id, CAST(1 + {_COUNT('string_agg(t, chr(10) ORDER BY line)')} AS BIGINT) AS complexity FROM own WHERE kind = 'function' GROUP BY id HAVING complexity >= 4",
    "repo_fact_graph": f"{_EDGES} SELECT * FROM edges",
    "repo_graph_validation": f"""{_EDGES}, nodes AS (SELECT path AS node FROM files UNION ALL SELECT id FROM sym), more AS (SELECT src, dst, kind, line FROM edges UNION ALL VALUES ('src/none.ts', 'src/nothing.ts', 'imports', 1), ('src/none.ts', 'src/none.ts', 'imports', 1))
SELECT 'duplicate_node' AS problem, count(*) AS n FROM (SELECT node FROM nodes GROUP BY node HAVING count(*) > 1) UNION ALL SELECT 'dangling_source', count(*) FROM more WHERE src NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'dangling_target', count(*) FROM more WHERE dst NOT LIKE 'external:%' AND dst NOT IN (SELECT node FROM nodes) UNION ALL SELECT 'self_loop', count(*) FROM more WHERE src = dst UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT 1 FROM more GROUP BY src, dst, kind, line HAVING count(*) > 1)""",
    "repo_disconnected_files": f"{_EDGES} SELECT path FROM files WHERE path NOT IN (SELECT p FROM (SELECT {_FILE.format('src')} AS p FROM edges WHERE kind <> 'defines' UNION ALL SELECT {_FILE.format('dst')} FROM edges WHERE kind <> 'defines') WHERE p IS NOT NULL)",
    "repo_dead_code": f"{_EDGES}, {_CH} SELECT id, kind FROM sym JOIN ch USING (path) WHERE kind <> 'section' AND id NOT IN (SELECT dst FROM edges WHERE kind IN ('calls', 'references') AND {_FILE.format('src')} <> {_FILE.format('dst')})",
    "repo_tests_of_change": f"WITH {_F}, {_SYM}, {_CH}, {_TESTS} SELECT * FROM tst",
    "repo_change_impact": f"{_IMPACT} SELECT * FROM imp_all",
    "repo_impact_summary": f"{_IMPACT} SELECT *, CASE WHEN n > 100 THEN 'high' WHEN n > 10 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT kind, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM imp_all GROUP BY kind)",
    "repo_shortest_paths": f"""WITH RECURSIVE {_EDGES[5:]}, e AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'imports' AND dst NOT LIKE 'external:%' AND src <> dst),
w AS (SELECT path AS node, 0::BIGINT AS hops, [path] AS route FROM files WHERE (path LIKE 'tests/%' OR path LIKE 'docs/%') AND (path LIKE '%9.md' OR path LIKE '%2.test.ts')
 UNION ALL SELECT e.dst, hops + 1, list_append(route, e.dst) FROM w JOIN e ON e.src = w.node WHERE hops < 5)
SELECT node, hops, array_to_string(route, ' > ') AS route FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, route) AS k FROM w) WHERE k = 1""",
    "repo_parser_coverage": f"WITH {_F}, {_SYM} SELECT {_LANG} AS language, count(*) AS files, count(n) AS with_symbols, round(count(n) / count(*)::DOUBLE, 4) AS ratio FROM files LEFT JOIN (SELECT DISTINCT path, 1 AS n FROM sym) s USING (path) GROUP BY 1",
    "check_test_quality": f"WITH {_F} SELECT path, unnest(list_filter([CASE WHEN contains(content, 'test.skip(') THEN 'skipped_test' END, CASE WHEN NOT contains(content, 'expect') THEN 'assertion_free_test' END, CASE WHEN contains(content, 'toMatchSnapshot') AND NOT contains(content, 'toBe') THEN 'snapshot_only_test' END], lambda x: x IS NOT NULL)) AS finding FROM files WHERE path LIKE 'tests/%'",
}
