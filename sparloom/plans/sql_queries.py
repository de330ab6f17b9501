"""Queries that one SQL text says best; Spark runs it over the tables as they are, and where the dialects
agree the oracle is the same text."""

from __future__ import annotations

import math
import re

from ..sources.tables import table

_TABLES = ("documents", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region", "conversations", "labels", "pages", "benchmark")


def _query(sql: str):
    used = [t for t in _TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return lambda spark, d: spark.sql(text, **{t: table(spark, d, t) for t in used})


# name: (Spark SQL, DuckDB SQL where it differs)
_SQL: dict[str, tuple[str, str | None]] = {
    # explicit feedback and trace scoring
    "policy_loop_health": (
        """SELECT event_type AS phase, count(*) AS runs, count(CASE WHEN value > 100 THEN 1 END) AS slow, CASE WHEN count(CASE WHEN value > 100 THEN 1 END) * 2 > count(*) THEN 'warning' ELSE 'ok' END AS health FROM events GROUP BY event_type""", None),
    # event-sourced state
    "task_inbox_counts": (
        """SELECT conv_id AS task_id, count(*) AS inbox_count, count(CASE WHEN role = 'user' THEN 1 END) AS pending_ack FROM conversations GROUP BY conv_id""", None),
    "resume_missing": (
        """SELECT o.o_orderkey FROM orders o LEFT ANTI JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
        """SELECT o.o_orderkey FROM orders o ANTI JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""),
    # freshness and health
    "index_fingerprint": (
        """SELECT lang, sha2(array_join(array_sort(collect_list(concat(CAST(doc_id AS STRING), ':', sha2(text, 256)))), '\\n'), 256) AS fingerprint FROM documents GROUP BY lang""",
        """SELECT lang, sha256(string_agg(e, chr(10) ORDER BY e)) AS fingerprint FROM (SELECT lang, CAST(doc_id AS VARCHAR) || ':' || sha256(text) AS e FROM documents) x GROUP BY lang"""),
    # checks
    "check_dead_code": (
        """SELECT p.p_partkey FROM part p LEFT ANTI JOIN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') u ON p.p_partkey = u.l_partkey""",
        """SELECT p.p_partkey FROM part p ANTI JOIN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') u ON p.p_partkey = u.l_partkey"""),
    "plan_conflict_markers": (
        """SELECT doc_id, CAST(size(filter(split(text, '\\n'), l -> startswith(l, '<<<<<<<') OR startswith(l, '=======') OR startswith(l, '>>>>>>>'))) AS BIGINT) AS markers FROM documents""",
        """SELECT doc_id, CAST(len(list_filter(str_split(text, chr(10)), lambda l: starts_with(l, '<<<<<<<') OR starts_with(l, '=======') OR starts_with(l, '>>>>>>>'))) AS BIGINT) AS markers FROM documents"""),
    "plan_tool_groups": (
        """SELECT p_type AS plane, count(*) AS tools, count(CASE WHEN p_size <= 25 THEN 1 END) AS visible, count(*) - count(DISTINCT p_name) AS duplicate_names FROM part GROUP BY p_type""", None),
    "plan_next_step": (
        """SELECT user_id, min(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END) AS first_done, count(DISTINCT event_type) AS done, CASE WHEN count(CASE WHEN event_type = 'signup' THEN 1 END) = 0 THEN 'signup' WHEN count(CASE WHEN event_type = 'purchase' THEN 1 END) = 0 THEN 'purchase' ELSE 'none' END AS next_step FROM events GROUP BY user_id""", None),
    # further joins, windows and set operations
    "join_longest_prefix": (
        """SELECT p.page_id, CAST(max(length(r.root)) AS BIGINT) AS root_length FROM pages p JOIN (VALUES ('http'), ('http://'), ('https://'), ('https://www.'), ('http://m.')) r(root) ON startswith(p.url, r.root) GROUP BY p.page_id""",
        """SELECT p.page_id, CAST(max(length(r.root)) AS BIGINT) AS root_length FROM pages p JOIN (VALUES ('http'), ('http://'), ('https://'), ('https://www.'), ('http://m.')) r(root) ON starts_with(p.url, r.root) GROUP BY p.page_id"""),
    "join_fallback_key": (
        """SELECT o.o_orderkey, coalesce(a.n, b.n, 0) AS community FROM orders o LEFT JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_acctbal > 0) a ON o.o_custkey = a.c_custkey LEFT JOIN (SELECT c_custkey, c_custkey % 7 AS n FROM customer) b ON o.o_custkey = b.c_custkey""", None),
    "window_nearest": (
        """SELECT l_orderkey, l_linenumber, near FROM (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS near, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY abs(a.l_quantity - b.l_quantity), b.l_linenumber) AS k FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber) x WHERE k = 1""", None),
    "window_carry_forward": (
        """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM events""",
        """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM events"""),
    "window_body_extent": (
        """SELECT l_orderkey, l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, 99) AS last_line FROM lineitem""", None),
    "set_edge_dedup": (
        """SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey""", None),
    "top_per_shard_merge": (
        """SELECT shard, doc_id, n_chars FROM (SELECT source AS shard, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) s WHERE k <= 3 ORDER BY n_chars DESC, doc_id LIMIT 20""", None),
    "agg_evidence_requirements": (
        """SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS has_brief, max(CASE WHEN role = 'assistant' AND length(text) > 200 THEN 1 ELSE 0 END) = 1 AS has_answer, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) + max(CASE WHEN role = 'assistant' AND length(text) > 200 THEN 1 ELSE 0 END) = 2 AS satisfied FROM conversations GROUP BY conv_id""", None),
}

#: Rows of ``lineitem`` that one task pairs within their orders; a task sorts some four pairs a row.
ROWS_A_TASK = 262_144


def nearest(spark, d):
    """The pairs of an order's lines are made where the order's lines lie, dealt over tasks by their number."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tasks = math.ceil(rows.count() / ROWS_A_TASK)
    text = re.sub(r"\b(FROM|JOIN) lineitem\b", r"\1 {lineitem}", _SQL["window_nearest"][0])
    return spark.sql(text, lineitem=rows if tasks < 2 else rows.repartition(tasks, "l_orderkey"))


QUERIES = {k: _query(v[0]) for k, v in _SQL.items()} | {"window_nearest": nearest}
ORACLES = {k: re.sub(r"(\d\.\d+)D\b", r"\1::DOUBLE", v[0]) if v[1] == "D" else v[1] or v[0] for k, v in _SQL.items()}
