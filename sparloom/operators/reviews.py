"""Rules over records: scores, ledgers, folds of event logs, and reviews of paths, changes and commands.

Column expressions where one row decides; joins and grouped aggregates where several do. Survey rows: POL-02,
POL-07, POL-08, POL-09, POL-10, POL-13, AGG-06, EVT-01, EVT-02, EVT-03, EVT-09, EVT-10, EVT-12, CDC-05, CDC-07,
CHK-02, CHK-05, CHK-06, TXT-04, TXT-05, TXT-09, TXT-11, TXT-14, TXT-17, PTH-03, FLT-01, FLT-04, SRC-21, SRC-23, SRC-25,
SRC-27, JN-12, TOP-06, WIN-10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..storage import stored

# Weights and shares of a reasoning score.
OUTCOME_SCORE = {"succeeded": 1.0, "partial": 0.65}
# Kinds of claims whose failure blocks.
HIGH_RISK_CLAIMS = ("verification_passed", "impact_tests_found", "generated_artifact_fresh", "deletion_safety", "change_safe")
# Phrases of plans that are larger than they need to be; the first three are high.
LARGE_PHRASES = ("kubernetes", "microservice", "distributed event bus", "event bus", "rewrite", "new framework", "queue", "cache layer", "multi-tenant", "plugin marketplace")
# Kinds of secrets.
SECRETS = (
    ("openai-api-key", "high", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", 0),
    ("github-token", "high", r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b", 0),
    ("aws-access-key", "high", r"\bAKIA[0-9A-Z]{16}\b", 0),
    ("private-key", "high", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("credential-assignment", "medium", r"(?i)\b(?:API_KEY|TOKEN|SECRET|PASSWORD)\s*=\s*[\"']?([A-Za-z0-9_./+=-]{12,})[\"']?", 1),
)
PLACEHOLDER = r"(?i)^(example|changeme|placeholder|your_|xxx)"
# How far a source is trusted, by its class.
AUTHORITY_SCORE = {"current_code": 1.0, "current_test": 0.95, "current_migration": 0.95, "current_config": 0.9, "supporting_doc": 0.35, "generated_note": 0.2, "unknown": 0.25}


def bounded(c: Column) -> Column:
    """Into 0 to 1; null and what is no number is 0 (MTH-01)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def reasoning_score(t: DataFrame) -> DataFrame:
    """t with total, coverage, questions, structure, outcome_score, penalty (POL-08). Columns used: evidence_available,
    evidence_referenced, resolved, remaining, strategy, outcome, corrections, has_plan, has_critique, has_revision,
    has_verifier."""
    one = lambda c: F.col(c).cast("double")
    coverage = F.when(F.col("evidence_available") <= 0, 1.0).otherwise(bounded(one("evidence_referenced") / F.nullif(one("evidence_available"), F.lit(0.0))))
    total = F.col("resolved") + F.col("remaining")
    questions = F.when(total <= 0, 1.0).otherwise(bounded(one("resolved") / F.nullif(total.cast("double"), F.lit(0.0))))
    structure = F.when(F.col("strategy") == "plan-first", one("has_plan")).when(F.col("strategy") == "critique-revise", (one("has_plan") + one("has_critique") + one("has_revision") + one("has_verifier")) / 4).otherwise((one("has_plan") + one("has_revision") + one("has_verifier")) / 3)
    outcome = F.lit(0.0)
    for name, v in OUTCOME_SCORE.items():
        outcome = F.when(F.col("outcome") == name, v).otherwise(outcome)
    penalty = bounded(one("corrections") / 5) * 0.3
    out = t.withColumns({"coverage": coverage, "questions": questions, "structure": structure, "outcome_score": outcome, "penalty": penalty})
    out = out.withColumn("total", bounded(F.col("coverage") * 0.3 + F.col("questions") * 0.2 + F.col("structure") * 0.2 + F.col("outcome_score") * 0.3 - F.col("penalty")))
    return out.withColumns({c: F.round(c, 4) for c in ("coverage", "questions", "structure", "outcome_score", "penalty", "total")})


def strategy_summary(scored: DataFrame) -> DataFrame:
    """strategy, samples, mean_score, success_rate, recommended: the best of at least two samples (AGG-06)."""
    by = scored.groupBy("strategy").agg(F.count("*").alias("samples"), F.round(F.avg("total"), 4).alias("mean_score"), F.round(F.avg((F.col("outcome") == "succeeded").cast("double")), 4).alias("success_rate"))
    # a row for each strategy only
    best = by.orderBy(F.desc("mean_score"), F.desc("success_rate"), "strategy").limit(1).where("samples >= 2").select("strategy", F.lit(True).alias("recommended"))
    return by.join(best, "strategy", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


def best_profile(tasks: DataFrame, profiles: list[dict]) -> DataFrame:
    """task, profile, score: the best profile of a small catalogue (POL-09): hard filters, then points; ties go by id.
    tasks has task, required, mode, requires_privacy."""
    choices = []
    for rank, p in enumerate(sorted(profiles, key=lambda p: p["id"])):
        score = 10 * F.size(F.array_intersect("required", F.array(*map(F.lit, p["strengths"])))) + F.when(F.col("mode").isin(p["modes"]), 5).otherwise(0)
        score = score + F.when(F.col("requires_privacy") & F.lit(p["privacy"] == "local"), 6).otherwise(0) + F.when(F.lit(p["latency"] == "low") & (F.col("mode") == "fast"), 3).otherwise(0) + (1 if p["cost"] == "low" else 0)
        choices.append(F.when(~F.col("requires_privacy") | F.lit(p["privacy"] == "local"), F.struct(score.cast("long").alias("score"), F.lit(-rank).alias("rank"), F.lit(p["id"]).alias("profile"))))
    best = F.array_max(F.array_compact(F.array(*choices)))
    return tasks.select("task", best.alias("b")).select("task", "b.profile", "b.score")


def routing(t: DataFrame) -> DataFrame:
    """mode, max_depth, verifiers by risk, ambiguity and size of the repository (POL-10)."""
    any_of = lambda v, size: (F.col("risk") == v) | (F.col("ambiguity") == v) | (F.col("repo_size") == size)
    mode = F.when(any_of("high", "large"), "deep").when(any_of("medium", "medium"), "balanced").otherwise("fast")
    return t.withColumn("mode", mode).withColumn("max_depth", F.when(F.col("mode") == "deep", 4).when(F.col("mode") == "balanced", 3).otherwise(2)).withColumn("verifiers", F.when(F.col("mode") == "deep", 2).when(F.col("mode") == "balanced", 1).otherwise(0))


def state_key(kind: Column, nodes: Column, evidence: Column, open_questions: Column, passed: Column) -> Column:
    """POL-02."""
    return F.concat_ws("|", kind, F.concat(F.lit("graph:"), F.when(nodes < 50, "small").when(nodes < 500, "medium").otherwise("large")), F.concat(F.lit("evidence:"), F.when(evidence < 2, "low").when(evidence < 8, "medium").otherwise("high")), F.concat(F.lit("risk:"), F.when((open_questions > 0) | ~passed, "high").otherwise("low")))


def action_key(workers: Column, verifiers: Column, depth: Column, model: Column) -> Column:
    """POL-02: an action with its numbers in bounds and unknown models replaced."""
    within = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).cast("int").cast("string")
    safe = F.when(model.isin("fast", "balanced", "deep", "ultra", "small-local", "deep-reviewer"), model).otherwise("balanced")
    return F.concat_ws("|", F.concat(F.lit("workers="), within(workers, 1, 6)), F.concat(F.lit("verifiers="), within(verifiers, 0, 2)), F.concat(F.lit("depth="), within(depth, 1, 4)), F.concat(F.lit("model="), safe))


def live_advice(passed: Column, open_questions: Column, tokens: Column, evidence: Column) -> Column:
    """POL-07: what to change on the next run, in order, joined by commas."""
    parts = F.array_compact(F.array(F.when(~passed, "strict-verification"), F.when(open_questions > 0, "escalate"), F.when(tokens > 50_000, "small-context"), F.when(evidence < 2, "strict-evidence")))
    return F.when(F.size(parts) == 0, "none").otherwise(F.array_join(parts, ","))


def invalidate(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims (claim_id, status, keys) with those stale that have one of the keys (key) (EVT-02)."""
    hit = claims.where("status <> 'stale'").select("claim_id", F.explode("keys").alias("key")).join(keys.select("key"), "key", "left_semi").select("claim_id").distinct().withColumn("hit", F.lit(True))
    return claims.join(hit, "claim_id", "left").select("claim_id", "kind", F.when(F.col("hit"), "stale").otherwise(F.col("status")).alias("status"))


def claim_gate(claims: DataFrame, enforce: bool) -> DataFrame:
    """claim_id, rule, severity of claims that aren't supported (EVT-03)."""
    block = F.lit(enforce) & F.col("kind").isin(*HIGH_RISK_CLAIMS) & (F.col("status") != "unverified")
    return claims.where("status <> 'supported'").select("claim_id", F.concat(F.lit("claim-ledger:"), "status").alias("rule"), F.when(block, "block").otherwise("warn").alias("severity"))


def next_ids(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest number behind a dash in ``id`` (WIN-10), by range partitions: each counts
    its rows, and starts where the ones before end."""
    top = existing.agg(F.max(F.regexp_extract("id", r"-([0-9]+)$", 1).try_cast("long"))).first()[0] or 0
    placed = stored(new.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    start, at = {}, top
    for p, n in counts:
        start[p], at = at, at + n
    first = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map(F.lit(0), F.lit(top))
    return placed.withColumn("n", F.element_at(first, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(*order))).drop("part")


def mission_states(events: DataFrame) -> DataFrame:
    """The state of each mission after all of its events (EVT-01, STR-04): events has mission, seq, type, key, value.
    round: the largest started; questions and tasks: the last word on each key; gate: the last. A task is paused by
    pause_until_ack until acknowledged and interrupted by immediate_stop. A mission whose first event isn't its
    start is an error."""
    first = events.groupBy("mission").agg(F.min_by("type", "seq").alias("first")).where("first <> 'mission.started'").limit(1).collect()
    if first:
        raise ValueError(f"an event before the start of mission {first[0]['mission']}")
    last = events.where("type LIKE 'question.%'").groupBy("mission", "key").agg(F.max_by("value", "seq").alias("v")).groupBy("mission").agg(F.count_if(F.col("v") == "open").alias("open_questions"))
    # what a task's status hangs on: the last report or stop, and the last pause or acknowledgement behind it
    task = events.where("type LIKE 'task.%' OR type LIKE 'control.%'").groupBy("mission", "key").agg(
        F.max_by(F.when(F.col("type").startswith("task."), F.col("value")).otherwise("interrupted"), F.when(F.col("type").startswith("task.") | (F.col("value") == "immediate_stop") & (F.col("type") == "control.message_sent"), F.col("seq"))).alias("base"),
        F.max(F.when(F.col("type").startswith("task.") | ((F.col("value") == "immediate_stop") & (F.col("type") == "control.message_sent")), F.col("seq"))).alias("base_at"),
        F.max(F.when((F.col("type") == "control.message_sent") & (F.col("value") == "pause_until_ack"), F.col("seq"))).alias("paused_at"),
        F.max(F.when((F.col("type") == "control.message_acknowledged") & (F.col("value") == "pause_until_ack"), F.col("seq"))).alias("acked_at"),
    )
    none = F.lit(-1)
    paused, acked, base = (F.coalesce(c, none) for c in ("paused_at", "acked_at", "base_at"))
    status = F.when((paused > base) & (acked > paused), "running").when(paused > base, "paused").otherwise(F.col("base"))
    tasks = task.withColumn("status", status).groupBy("mission").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "paused").alias("paused"), F.count_if(F.col("status") == "interrupted").alias("interrupted"))
    base = events.groupBy("mission").agg(F.coalesce(F.max(F.when(F.col("type") == "round.started", F.col("value").try_cast("int"))), F.lit(0)).alias("rounds"), F.count_if(F.col("type") == "evidence.recorded").alias("evidence"), F.max_by("type", F.when(F.col("type").startswith("gate."), F.col("seq"))).alias("gate"), F.count("*").alias("events"))
    return base.join(last, "mission", "left").join(tasks, "mission", "left").na.fill(0)


def index_health(present: Column, fresh: Column, truncated: Column, uncovered: Column) -> Column:
    """CDC-05: missing, then stale, degraded, fresh, unknown."""
    return F.when(~present, "missing").when(~fresh, "stale").when(truncated | (uncovered > 0), "degraded").when(fresh, "fresh").otherwise("unknown")


def docs_sync(changed: DataFrame) -> DataFrame:
    """group, public, docs, finding of changed paths by group (CHK-05)."""
    by = changed.groupBy("group").agg(F.count_if(P.is_public_surface(F.col("path"))).alias("public"), F.count_if(P.is_docs(F.col("path"))).alias("docs"))
    return by.withColumn("finding", F.when((F.col("public") > 0) & (F.col("docs") == 0), "missing_docs").otherwise("none"))


def operation_risk(command: Column) -> Column:
    """high, medium or low of a command line (CHK-06)."""
    line = F.lower(command)
    high = (line.rlike(r"^git push\b") & line.rlike(r" (--force|-f)( |$)")) | (line.rlike(r"^git reset\b") & line.rlike(r" --hard( |$)")) | (line.rlike(r"^(rm|del|remove-item) ") & line.rlike(r"(-rf|-r|/s|recursive)")) | line.rlike(r"curl\s+.+\|\s*(sh|bash|pwsh|powershell)")
    return F.when(high, "high").when(line.rlike(r"^npm (install|publish)( |$)"), "medium").otherwise("low")


def scope_tokens(c: Column) -> Column:
    """Words of three characters at least, camel case cut (TXT-04)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def search_terms(c: Column) -> Column:
    """Chunks of letters, digits, _ and -, and their parts (TXT-05)."""
    chunks = F.filter(F.split(F.lower(c), "[^a-z0-9_-]+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(chunks, F.flatten(F.transform(chunks, lambda x: F.filter(F.split(x, "[_-]+"), lambda y: y != ""))))))


def diff_scope(hunks: DataFrame, objective: str, approved: list[str]) -> DataFrame:
    """path, line, finding (CHK-02): files and hunks (path, line, added) that neither the objective's words nor an
    approved path explains."""
    own = scope_tokens(F.lit(objective))
    under = F.lit(False)
    for a in approved:
        under = under | P.is_under(F.col("path"), F.lit(a.rstrip("/")))
    h = hunks.withColumns({"by_path": F.arrays_overlap(scope_tokens(F.col("path")), own) | under, "by_text": F.arrays_overlap(scope_tokens(F.col("added")), own)})
    files = h.groupBy("path").agg(F.max(F.col("by_path") | F.col("by_text")).alias("ok")).where("NOT ok").select("path", F.lit(None).cast("long").alias("line"), F.lit("unjustified_file").alias("finding"))
    return files.unionByName(h.where("NOT by_path AND NOT by_text").select("path", "line", F.lit("unjustified_hunk").alias("finding")))


def minimality(c: Column) -> Column:
    """The large phrases of a plan with their severity, in order (TXT-14)."""
    low = F.lower(c)
    return F.array_join(F.array_compact(F.array(*[F.when(low.contains(p), f"{'high' if k < 3 else 'medium'}:{p}") for k, p in enumerate(LARGE_PHRASES)])), ",")


def secret_findings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line, kind, severity, redacted (TXT-09): by line, placeholders left out, of equal values in a line the
    first kind."""
    lines = X.lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text")
    kinds = F.flatten(F.array(*[F.transform(F.regexp_extract_all("line_text", F.lit(p), F.lit(g)), lambda v: F.struct(F.lit(k).alias("nth"), F.lit(name).alias("kind"), F.lit(sev).alias("severity"), v.alias("value"))) for k, (name, sev, p, g) in enumerate(SECRETS)]))  # noqa: B023
    found = lines.select("id", "line", F.explode(kinds).alias("s")).where(~F.col("s.value").rlike(PLACEHOLDER))
    once = found.groupBy("id", "line", F.col("s.value").alias("value")).agg(F.min("s").alias("s"))
    redacted = F.when(F.length("value") <= 8, "...").otherwise(F.concat(F.substring("value", 1, 3), F.lit("..."), F.right("value", F.lit(4))))
    return once.select("id", "line", "s.kind", "s.severity", redacted.alias("redacted"))


def feature_id(c: Column) -> Column:
    """Dashed lower-case name of a feature (TXT-17)."""
    for pattern, to in ((r"^use(?=[A-Z])", ""), ("([a-z0-9])([A-Z])", "$1-$2"), (r"[_\s]+", "-"), ("[^a-zA-Z0-9-]", ""), ("-+", "-"), ("^-|-$", "")):
        c = F.regexp_replace(c, pattern, to)
    return F.lower(c)


def context_line(i: Column, source: Column, text: Column, size: int = 240) -> Column:
    """[id] source: text, cut (TXT-11)."""
    return F.concat(F.lit("["), i.cast("string"), F.lit("] "), source, F.lit(": "), F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text))


def authority(path: Column) -> Column:
    """The class of a source by its path (PTH-03)."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(generated|notes)/|[._-]generated\."), "generated_note").when(P.is_docs(path), "supporting_doc").when(P.is_test(low), "current_test")
        .when(low.startswith("migrations/") | low.endswith(".sql"), "current_migration").when(low.rlike(r"\.(json|ya?ml|toml)$|(^|/)[^/]*config\.[a-z]+$"), "current_config")
        .when(P.language(path).isin("typescript", "javascript", "python", "rust", "csharp", "shell", "powershell"), "current_code").otherwise("unknown")
    )


def authority_score(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in AUTHORITY_SCORE.items() for x in kv]), name)


def remit_status(kind: Column, observed: Column, declared: Column) -> Column:
    """POL-13: allowed sets: none observed, more than declared, less, equal; forbidden sets: any overlap."""
    allowed = F.when(F.size(observed) == 0, "enforcement_not_possible").when(F.size(F.array_except(observed, declared)) > 0, "gap").when(F.size(F.array_except(declared, observed)) > 0, "partial").otherwise("verified")
    return F.when(kind == "allowed", allowed).otherwise(F.when(F.size(F.array_intersect(observed, declared)) > 0, "gap").otherwise("verified"))


def git_status(lines: DataFrame) -> DataFrame:
    """staged, unstaged, untracked, renamed_from, path of porcelain lines (SRC-21, PLN-11)."""
    x, y, rest = F.substring("line", 1, 1), F.substring("line", 2, 1), F.substring("line", 4, 1 << 30)
    parts = F.split(rest, " -> ")
    return lines.select(
        F.element_at(parts, -1).alias("path"), F.when(F.size(parts) > 1, F.element_at(parts, 1)).alias("renamed_from"),
        (~x.isin(" ", "?")).alias("staged"), (~y.isin(" ", "?")).alias("unstaged"), (x == "?").alias("untracked"),
    )


def version_drift(current: Column, latest: Column) -> Column:
    """major, minor, patch or none (SRC-25): the first part, from the left, in which latest is larger."""
    part = lambda c, k: F.coalesce(F.try_element_at(F.split(c, r"\."), F.lit(k)).try_cast("int"), F.lit(0))
    return F.when(part(latest, 1) > part(current, 1), "major").when(part(latest, 2) > part(current, 2), "minor").when(part(latest, 3) > part(current, 3), "patch").otherwise("none")


def lsp_record(d: DataFrame) -> DataFrame:
    """Positions from 1 and names of severities (SRC-23); severities that are none of 1 to 4 are information."""
    name = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in ("error", "warning", "info", "hint")]), F.when(F.col("severity").between(1, 4), F.col("severity"))), F.lit("info"))
    return d.withColumns({"line": F.col("line") + 1, "column": F.col("column") + 1, "severity": name})


def workspace_edges(packages: DataFrame) -> DataFrame:
    """src, dst of dependencies (name, dependencies) that are packages here (SRC-27, JN-12, CHK-08)."""
    return packages.select(F.col("name").alias("src"), F.explode(F.array_distinct("dependencies")).alias("dst")).join(packages.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def matching(df: DataFrame, order: list, limit: int, **wanted: object) -> DataFrame:
    """Rows that meet all wanted values, None being no condition, with the number of all of them beside the first
    ``limit`` (FLT-01, TOP-06)."""
    for name, v in wanted.items():
        if v is not None:
            df = df.where(F.col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(name) == v)
    total = df.count()
    return df.orderBy(*order).limit(limit).withColumns({"total": F.lit(total).cast("long"), "truncated": F.lit(total > limit)})


def best_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The node that each target means (FLT-04): its symbol, its path, the end of a path; of equal ones the first. By
    equi-joins on names, paths and all ends of paths."""
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), k, F.size(F.split("path", "/"))), "/"))
    keys = nodes.select("node", "ordinal", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("key"))), F.array(F.struct(F.lit(1).alias("rank"), F.col("path").alias("key"))), F.transform(tails, lambda t: F.struct(F.lit(2).alias("rank"), t.alias("key"))))).alias("k")).where("k.key IS NOT NULL")
    best = keys.groupBy(F.col("k.key").alias("target")).agg(F.min_by("node", F.struct("k.rank", "ordinal")).alias("node"))
    return wanted.select("target").join(best, "target", "left")
