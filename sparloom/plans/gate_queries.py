"""Conflicts of guides with the facts, over the source files with claims added, and the gate's decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as A
from ..operators.reviews import HIGH_RISK_CLAIMS
from ..sources.tables import table
from . import repo_queries as Q
from . import review_queries as V

# Claims in the SQL that both engines read, after a guide's own text.
_DOCS = """SELECT 'docs/c' || k || '.md' AS path, '# About ' || k || chr(10) || 'See [a](g' || (k - k % 8 + 7) || '.md#top), [b](/src/core/m' || k || '.ts) and [c](https://x.example/' || k || ') ' || chr(10)
 || 'Start with npm run s' || (k % 9) || ' or yarn run all.' || chr(10) || 'Dependencies: lib' || (k % 7) || ', `zod`' || chr(10) || 'DB tables: orders, Part' || (k % 3) || ';' AS content FROM (SELECT p_partkey AS k, p_size AS s FROM part) p WHERE s % 5 = 0"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return Q.files(spark, d).unionByName(spark.sql(_DOCS.replace("FROM part)", "FROM {part})"), part=table(spark, d, "part")))


def _named(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def conflicts(spark, d):
    """Links to no file, scripts, dependencies and tables that there aren't, and artifacts of another index."""
    made = table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("dist/a"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("p_partkey") % 2 == 0, "now").otherwise("then").alias("fingerprint"))
    return A.source_conflicts(_files(spark, d), _named(spark, "s0", "s1", "s2", "s3", "s4", "s5"), _named(spark, "lib0", "lib1", "lib2", "lib3", "lib4"), _named(spark, "orders", "part1"), made, "now")


def findings(spark, d):
    """The signals of conflicts, health, behaviour, loops, claims and artifacts, enforced."""
    e, docs = table(spark, d, "events"), table(spark, d, "documents")
    health = docs.groupBy("source").agg(F.max("n_chars").alias("m")).select("source", F.when(F.col("m") <= 3000, "missing").when(F.col("m") <= 9000, "stale").when(F.col("m") > 60_000, "degraded").otherwise("fresh").alias("status"))
    n = e.groupBy(F.col("user_id").cast("string").alias("subject")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    behaviour = n.select("subject", F.when(F.col("errors") > 15, "blocker").when(F.col("errors") > 12, "warning").otherwise("ok").alias("status"))
    loops = n.select("subject", F.when(F.col("signups") > 18, "blocked").when(F.col("signups") > 14, "warning").otherwise("ok").alias("status"))
    claims = V.made(spark, d, V._CLAIMS).select("claim_id", "kind", "status")
    artifacts = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("out/"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_nationkey") < 8, "fresh").when(F.col("c_nationkey") < 16, "stale").otherwise("unknown").alias("status"))
    return A.signals(conflicts(spark, d), health, behaviour, loops, claims, artifacts, enforce=True)


QUERIES = {"domain_source_conflicts": conflicts, "gate_signals": findings, "gate_decision": lambda s, d: A.decision(findings(s, d))}
_RISK = ", ".join(f"'{k}'" for k in HIGH_RISK_CLAIMS)
_CONFLICTS = rf"""k AS (SELECT p_partkey AS k FROM part WHERE p_size % 5 = 0), f AS (SELECT path, content FROM ({Q._FILES}) UNION ALL {_DOCS}), names AS (SELECT path FROM f),
links AS (SELECT 'docs/c' || k || '.md' AS path, 2 AS line, 'docs/g' || (k - k % 8 + 7) || '.md' AS target FROM k UNION ALL SELECT 'docs/c' || k || '.md', 2, 'src/core/m' || k || '.ts' FROM k
 UNION ALL SELECT 'docs/g' || p_partkey || '.md', 2, 'docs/g' || (p_partkey - 8) || '.md' FROM part WHERE p_partkey % 8 = 7 UNION ALL SELECT 'docs/g' || p_partkey || '.md', 2, 'src/core/m' || (p_partkey - 3) || '.ts' FROM part WHERE p_partkey % 8 = 7),
said AS (SELECT 'script' AS kind, 's' || k % 9 AS name, k, 3 AS line FROM k WHERE k % 9 > 5 UNION ALL SELECT 'script', 'all', k, 3 FROM k UNION ALL SELECT 'dependency', 'lib' || k % 7, k, 4 FROM k WHERE k % 7 > 4 UNION ALL SELECT 'dependency', 'zod', k, 4 FROM k UNION ALL SELECT 'table', 'part' || k % 3, k, 5 FROM k WHERE k % 3 <> 1),
cf AS (SELECT DISTINCT * FROM (SELECT 'link' AS kind, path || ' -> ' || target AS subject, path, line, 'warning' AS severity, 'needs_validation' AS resolution FROM links WHERE target NOT IN (SELECT path FROM names)
 UNION ALL SELECT kind, kind || ':' || name, 'docs/c' || k || '.md', line, 'warning', 'trust_authoritative' FROM said UNION ALL SELECT 'artifact', 'dist/a' || p_partkey || '.json#indexFingerprint', 'dist/a' || p_partkey || '.json', NULL, 'stale', 'refresh' FROM part WHERE p_size = 7 AND p_partkey % 2 = 1))"""
_SIGNALS = f"""{_CONFLICTS}, h AS (SELECT source, max(n_chars) AS m FROM documents GROUP BY source), u AS (SELECT user_id::VARCHAR AS subject, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY user_id), cl AS ({V.duck(V._CLAIMS)}),
sg AS (SELECT DISTINCT * FROM (SELECT CASE WHEN severity = 'stale' THEN 'source-conflict:stale-generated-artifact' ELSE 'source-conflict:needs-review' END AS rule, CASE WHEN severity = 'stale' THEN 'block' ELSE 'warn' END AS severity, subject FROM cf
 UNION ALL SELECT 'index-health:' || CASE WHEN m <= 3000 THEN 'missing' WHEN m <= 9000 THEN 'stale' ELSE 'degraded' END, CASE WHEN m <= 9000 THEN 'block' ELSE 'warn' END, source FROM h WHERE m <= 9000 OR m > 60000
 UNION ALL SELECT CASE WHEN e > 15 THEN 'runtime-behavior:blocker' ELSE 'runtime-behavior:warning' END, CASE WHEN e > 15 THEN 'block' ELSE 'warn' END, subject FROM u WHERE e > 12
 UNION ALL SELECT CASE WHEN s > 18 THEN 'agent-loop-health:blocked' ELSE 'agent-loop-health:warning' END, CASE WHEN s > 18 THEN 'block' ELSE 'warn' END, subject FROM u WHERE s > 14
 UNION ALL SELECT 'claim-ledger:' || status, CASE WHEN status <> 'unverified' AND kind IN ({_RISK}) THEN 'block' ELSE 'warn' END, claim_id::VARCHAR FROM cl WHERE status <> 'supported'
 UNION ALL SELECT 'artifact-freshness:' || CASE WHEN c_nationkey < 16 THEN 'stale' ELSE 'unknown' END, 'block', 'out/' || c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey >= 8))"""
ORACLES = {
    "domain_source_conflicts": f"WITH {_CONFLICTS} SELECT * FROM cf",
    "gate_signals": f"WITH {_SIGNALS} SELECT * FROM sg",
    "gate_decision": f"WITH {_SIGNALS} SELECT count(*) FILTER (severity = 'block') = 0 AS open, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'block') AS blocks, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (severity = 'block'), '') AS rules FROM sg",
}
