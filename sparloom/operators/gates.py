"""What documents claim against the facts, and the signals of all reviews as one decision.

Claims are parsed line by line and meet the facts by anti join. Findings of every review have one schema, are united,
counted once each and decided together. Survey rows: DOM-09, EVT-04.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .repo import normalised
from .reviews import claim_gate

# Words that mark a line of claims, and are no claim themselves.
DEPENDENCIES, TABLES = r"(?i)\bdependenc(?:y|ies)\s*:", r"(?i)\b(?:db\s+)?tables?\s*:"
NOT_DEPENDENCIES, NOT_TABLES = ("dependency", "dependencies", "devdependencies"), ("table", "tables", "db")
RUN = r"\b(?:npm|pnpm|yarn|bun)\s+run\s+([A-Za-z0-9:_-]+)\b"


def _claimed(line: Column) -> Column:
    """The tokens behind a line's first colon and before its next."""
    after = F.coalesce(F.get(F.split(line, ":"), F.lit(1)), F.lit(""))
    return F.transform(F.split(after, r"[\s,;]+"), lambda t: F.regexp_replace(t, r"^[`'\"(\[]+|[`'\")\].]+$", ""))


def source_conflicts(files: DataFrame, scripts: DataFrame | None = None, dependencies: DataFrame | None = None, tables: DataFrame | None = None, artifacts: DataFrame | None = None, fingerprint: str = "") -> DataFrame:
    """kind, subject, path, line, severity, resolution of what documents among files (path, content) say and the facts
    (name) don't: links to no file, scripts, dependencies and tables that there aren't, and generated artifacts (path,
    fingerprint) of another index. Facts that aren't given, or are empty, contradict nothing."""
    docs = X.lines(files.where(P.is_docs(F.col("path"))).select("path", "content"), "content").select("path", "line", "line_text")
    href = F.explode(F.regexp_extract_all("line_text", F.lit(r"\[[^\]]+\]\(\s*([^)\s]+)[^)]*\)"), F.lit(1)))
    links = docs.select("path", "line", href.alias("href")).where(~F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:|^#"))
    clean = F.regexp_replace("href", r"[?#].*$", "")
    target = normalised(F.when(clean.startswith("/"), F.regexp_replace(clean, "^/+", "")).otherwise(F.concat(F.regexp_replace("path", "[^/]*$", ""), clean)))
    aimed = links.where(clean != "").select("path", "line", target.alias("target")).where("target IS NOT NULL AND target <> ''")
    lost = aimed.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    row = lambda df, kind, subject, resolution, severity="warning": df.select(F.lit(kind).alias("kind"), subject.alias("subject"), "path", "line", F.lit(severity).alias("severity"), F.lit(resolution).alias("resolution"))
    out = row(lost, "link", F.concat("path", F.lit(" -> "), "target"), "needs_validation")

    def claims(kind: str, tokens: Column, known: DataFrame | None, marker: str | None) -> None:
        nonlocal out
        if known is None:
            return
        lines = docs if marker is None else docs.where(F.col("line_text").rlike(marker))
        said = lines.select("path", "line", F.explode(F.array_distinct(tokens)).alias("name"))
        # one row, so that facts which are empty contradict nothing
        some = known.select("name").limit(1).select(F.lit(1).alias("_some"))
        wrong = said.join(known.select("name").distinct(), "name", "left_anti").join(F.broadcast(some), F.col("_some") == 1)
        out = out.unionByName(row(wrong, kind, F.concat(F.lit(f"{kind}:"), "name"), "trust_authoritative"))

    claims("script", F.regexp_extract_all("line_text", F.lit(RUN), F.lit(1)), scripts, None)
    claims("dependency", F.filter(_claimed(F.col("line_text")), lambda t: t.rlike("(?i)^[a-z0-9@][a-z0-9._/-]*$") & ~F.lower(t).isin(*NOT_DEPENDENCIES)), dependencies, DEPENDENCIES)
    claims("table", F.filter(F.transform(_claimed(F.col("line_text")), F.lower), lambda t: t.rlike("^[a-z][a-z0-9_]*$") & ~t.isin(*NOT_TABLES)), tables, TABLES)
    if artifacts is not None:
        stale = artifacts.where(F.col("fingerprint") != fingerprint).withColumn("line", F.lit(None).cast("long"))
        out = out.unionByName(row(stale, "artifact", F.concat("path", F.lit("#indexFingerprint")), "refresh", "stale"))
    return out.distinct()


def _level(enforce: bool) -> Column:
    return F.lit("block" if enforce else "warn")


def signals(conflicts: DataFrame | None = None, health: DataFrame | None = None, behaviour: DataFrame | None = None, loops: DataFrame | None = None, claims: DataFrame | None = None, artifacts: DataFrame | None = None, enforce: bool = False) -> DataFrame:
    """rule, severity (warn, block), subject: each finding once. conflicts: see ``source_conflicts``; health (source,
    status), behaviour and loops (subject, status), claims (claim_id, kind, status), artifacts (path, status). enforce:
    what else only warns blocks, where it may."""
    parts = []
    if conflicts is not None:
        rule = F.when(F.col("severity") == "stale", "stale-generated-artifact").when(F.col("severity") == "blocking", "blocking").otherwise("needs-review")
        level = F.when(F.col("severity") == "stale", _level(enforce)).when(F.col("severity") == "blocking", "block").otherwise("warn")
        parts.append(conflicts.select(F.concat(F.lit("source-conflict:"), rule).alias("rule"), level.alias("severity"), "subject"))
    if health is not None:
        known = F.when(F.col("status").isin("stale", "missing"), _level(enforce)).otherwise("warn")
        parts.append(health.where("status <> 'fresh'").select(F.concat(F.lit("index-health:"), "status").alias("rule"), known.alias("severity"), F.col("source").alias("subject")))
    if behaviour is not None:
        stop = F.col("status").isin("blocker", "blocked")
        parts.append(behaviour.where(stop | (F.col("status") == "warning")).select(F.when(stop, "runtime-behavior:blocker").otherwise("runtime-behavior:warning").alias("rule"), F.when(stop, "block").otherwise("warn").alias("severity"), "subject"))
    if loops is not None:
        stop = F.col("status") == "blocked"
        parts.append(loops.where(stop | (F.col("status") == "warning")).select(F.when(stop, "agent-loop-health:blocked").otherwise("agent-loop-health:warning").alias("rule"), F.when(stop, "block").otherwise("warn").alias("severity"), "subject"))
    if claims is not None:
        parts.append(claim_gate(claims, enforce).select("rule", "severity", F.col("claim_id").cast("string").alias("subject")))
    if artifacts is not None:
        parts.append(artifacts.where("status <> 'fresh'").select(F.concat(F.lit("artifact-freshness:"), "status").alias("rule"), _level(enforce).alias("severity"), F.col("path").alias("subject")))
    if not parts:
        raise ValueError("there is nothing to decide on")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def decision(findings: DataFrame) -> DataFrame:
    """One row: open (nothing blocks), warnings, blocks, rules (those that block, in order)."""
    block = F.col("severity") == "block"
    by_rule = findings.groupBy("rule").agg(F.count_if(block).alias("b"), F.count_if(~block).alias("w"))  # a row a rule
    return by_rule.agg((F.coalesce(F.sum("b"), F.lit(0)) == 0).alias("open"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("b") > 0, F.col("rule")))), ",").alias("rules"))
