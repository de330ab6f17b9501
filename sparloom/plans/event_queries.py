"""Event, trace, policy and snapshot queries, bound to ``events``, ``orders`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..sources.tables import table


def as_of(spark, d):
    """Errors with the user's last click before."""
    e = table(spark, d, "events")
    click = e.where("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    return E.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), click.groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("click_id")), "user_id", "ts", "ts", ["click_id", "value"]).select("event_id", "user_id", "right_click_id", "right_value")


_AS_OF = """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, c.click_id AS right_click_id, c.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts"""


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    v = F.concat_ws(":", F.col("o_orderstatus"), F.col("o_orderpriority"))
    before = o.where("o_orderkey % 10 <> 0").select("o_orderkey", v.alias("v"))
    after = o.where("o_orderkey % 10 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 2, F.concat(v, F.lit("!"))).otherwise(v).alias("v"))
    return before, after


_SNAP = """b AS (SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority AS v FROM orders WHERE o_orderkey % 10 <> 0),
a AS (SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority || CASE WHEN o_orderkey % 10 = 2 THEN '!' ELSE '' END AS v FROM orders WHERE o_orderkey % 10 <> 1)"""


def snapshot(spark, d):
    return E.snapshot_diff(*_snapshots(spark, d), "o_orderkey", "v")


def incremental(spark, d):
    """Line totals of orders, refreshed for changed orders only, as a summary by status."""
    before, after = _snapshots(spark, d)
    change = E.snapshot_diff(before, after, "o_orderkey", "v")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    derive = lambda t: t.join(li, "o_orderkey", "left").select("o_orderkey", "v", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    fresh = derive(after.join(change.where("change <> 'deleted'"), "o_orderkey", "left_semi"))
    gone = change.where("change = 'deleted'").select("o_orderkey")
    return E.incremental(derive(before).join(gone, "o_orderkey", "left_anti"), fresh, "o_orderkey").groupBy("v").agg(F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"))


_INCR = f"""WITH {_SNAP}, l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT v, count(*) AS n, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS n_lines FROM a LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY v"""


def traces(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    status = F.when(F.col("event_type").isin("purchase", "signup"), "succeeded").when(F.col("event_type") == "error", "failed").otherwise("partial")
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("profile"), status.alias("status"), F.col("value").alias("latency"), (k / 100).alias("quality"), k.alias("k"))


TRACES = """tr AS (SELECT event_id, user_id, ts, event_type AS profile, CASE WHEN event_type IN ('purchase', 'signup') THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' ELSE 'partial' END AS status, value AS latency, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS quality, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def running(spark, d):
    return E.running_mean(traces(spark, d), "profile", ["ts", "event_id"], "latency").select("event_id", "running_mean", "nth")


def _rewards(spark, d):
    t = traces(spark, d)
    r = E.reward(F.col("status") == "succeeded", (F.col("k") % 9).cast("int"), F.col("quality"), (F.col("k") % 4).cast("int"), (F.col("k") % 3).cast("int"), F.col("latency") * 1000, F.col("k") * 900)
    state = F.concat_ws("|", F.col("profile"), F.when(F.col("latency") < 30, "fast").when(F.col("latency") < 100, "medium").otherwise("slow"))
    action = F.concat_ws("|", F.concat(F.lit("w"), F.least(F.lit(8), F.greatest(F.lit(1), (F.col("k") % 4).cast("int"))).cast("string")), F.when(F.col("user_id") % 2 == 0, "wide").otherwise("narrow"))
    return t.select("event_id", "ts", state.alias("state"), action.alias("action"), r.alias("reward"))


REWARDS = f"""{TRACES}, rw AS (SELECT event_id, ts, profile || '|' || CASE WHEN latency < 30 THEN 'fast' WHEN latency < 100 THEN 'medium' ELSE 'slow' END AS state,
 'w' || CAST(least(8, greatest(1, CAST(k % 4 AS INT))) AS VARCHAR) || '|' || CASE WHEN user_id % 2 = 0 THEN 'wide' ELSE 'narrow' END AS action,
 round(CASE WHEN status = 'succeeded' THEN 10.0 ELSE -8.0 END::DOUBLE + 0.5::DOUBLE * least(CAST(k % 9 AS INT), 6) + 2 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(quality, 0.0::DOUBLE))) - 0.8::DOUBLE * least(CAST(k % 4 AS INT), 10) - 1.2::DOUBLE * least(CAST(k % 3 AS INT), 10) - least(latency * 1000 / 60000, 4.0::DOUBLE) - least(k * 900 / 50000, 4.0::DOUBLE), 4) AS reward FROM tr)"""


def q_values(spark, d):
    """Values of actions by state, learned from each user's first traces in order."""
    r = _rewards(spark, d)
    return r.groupBy("state", "action").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "reward"))), lambda x: x["reward"]).alias("rewards")).select("state", "action", F.round(E.q_fold(F.col("rewards")), 4).alias("q"), F.size("rewards").cast("long").alias("visits"))


QFOLD = f"""{REWARDS}, ls AS (SELECT state, action, list(reward ORDER BY ts, event_id) AS rs FROM rw GROUP BY state, action),
q AS (SELECT state, action, round(list_reduce(list_concat([0.0::DOUBLE], rs, rs, rs, rs), lambda q, r: round(q + 0.3::DOUBLE * (r - q), 6)), 4) AS q, CAST(len(rs) AS BIGINT) AS visits FROM ls)"""


def replay(spark, d):
    """How often the logged action is the best one, under both tie rules, and the mean reward."""
    r, q = _rewards(spark, d), q_values(spark, d)
    lo, hi = E.best_action(q, "state", "action", "q", "min").select("state", F.col("best").alias("low")), E.best_action(q, "state", "action", "q", "max").select("state", F.col("best").alias("high"))
    return r.join(lo, "state").join(hi, "state").groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg((F.col("action") == F.col("low")).cast("int")), 4).alias("pass_min"), F.round(F.avg((F.col("action") == F.col("high")).cast("int")), 4).alias("pass_max"), F.round(F.avg("reward"), 4).alias("mean_reward"))


_REPLAY = f"""WITH {QFOLD}, lo AS (SELECT state, action FROM q QUALIFY row_number() OVER (PARTITION BY state ORDER BY q DESC, action) = 1), hi AS (SELECT state, action FROM q QUALIFY row_number() OVER (PARTITION BY state ORDER BY q DESC, action DESC) = 1)
SELECT rw.state, count(*) AS n, round(avg(CASE WHEN rw.action = lo.action THEN 1 ELSE 0 END), 4) AS pass_min, round(avg(CASE WHEN rw.action = hi.action THEN 1 ELSE 0 END), 4) AS pass_max, round(avg(reward), 4) AS mean_reward FROM rw JOIN lo ON rw.state = lo.state JOIN hi ON rw.state = hi.state GROUP BY rw.state"""


def replay_state(spark, d):
    """The state of each user after all events: counts, the last event of all, of purchases the last value."""
    e = table(spark, d, "events")
    seq = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", seq).alias("last_type"), F.max("event_id").alias("max_event"), F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", seq)).alias("last_purchase"), F.count_if(F.col("event_type") == "error").alias("errors"))


_STATE = """SELECT user_id, count(*) AS n_events, last(event_type ORDER BY ts, event_id) AS last_type, max(event_id) AS max_event, last(value ORDER BY ts, event_id) FILTER (event_type = 'purchase') AS last_purchase, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id"""


def order_violations(spark, d):
    """Users whose first purchase comes before their first view, or without one."""
    f = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("p"), F.min(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).alias("v"))
    return f.where("p IS NOT NULL AND (v IS NULL OR p < v)").select("user_id", F.col("p.event_id").alias("purchase_id"), F.when(F.col("v").isNull(), "missing").otherwise("later").alias("violation"))


_VIOLATIONS = """WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, min(n) FILTER (event_type = 'purchase') AS p, min(n) FILTER (event_type = 'view') AS v FROM o GROUP BY user_id)
SELECT f.user_id, o.event_id AS purchase_id, CASE WHEN v IS NULL THEN 'missing' ELSE 'later' END AS violation FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.p WHERE v IS NULL OR p < v"""


def missions(spark, d):
    """Status of conversations as missions: rounds, evidence, open questions, gate."""
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("mission_id")).agg(F.max("turn").alias("round"), F.count_if(F.col("role") == "assistant").alias("evidence"), F.greatest(F.lit(0), F.count_if(F.col("role") == "user") - F.count_if(F.col("role") == "assistant")).cast("long").alias("open_questions"), F.max_by("role", "turn").alias("last_role")).withColumn("gate", F.when((F.col("evidence") > 0) & (F.col("open_questions") == 0), "open").otherwise("closed"))


_MISSIONS = """WITH m AS (SELECT conv_id AS mission_id, max(turn) AS round, count(*) FILTER (role = 'assistant') AS evidence, greatest(0, count(*) FILTER (role = 'user') - count(*) FILTER (role = 'assistant')) AS open_questions, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
SELECT *, CASE WHEN evidence > 0 AND open_questions = 0 THEN 'open' ELSE 'closed' END AS gate FROM m"""


def retention(spark, d):
    """The five newest events of each user and type."""
    e = table(spark, d, "events")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("nth <= 5").select("event_id", F.col("nth").cast("long").alias("nth"))


def conflicts(spark, d):
    """Workspace keys whose newest record stands, and those with several contents."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", "role").agg(F.countDistinct(F.sha2("text", 256)).alias("n_hashes"), F.max("turn").alias("latest_turn")).withColumn("conflict", F.col("n_hashes") > 1)


def baselines(spark, d):
    """Fixed policies against the learned one: share of traces that take the policy's action, and their reward."""
    r = _rewards(spark, d)
    one = lambda name, test: r.where(test).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 4).alias("mean_reward"), F.round(F.avg((F.col("reward") > 0).cast("int")), 4).alias("pass_rate")).select(F.lit(name).alias("policy"), "n", "mean_reward", "pass_rate")
    return one("always-wide", "action LIKE '%wide'").unionByName(one("single-worker", "action LIKE 'w1|%'")).unionByName(one("three-workers", "action LIKE 'w3|%'")).withColumn("active", (F.col("pass_rate") >= 0.9) & (F.col("n") >= 50) & (F.col("mean_reward") > 0))


_BASELINES = f"""WITH {REWARDS}, p(policy, pat) AS (VALUES ('always-wide', '%wide'), ('single-worker', 'w1|%'), ('three-workers', 'w3|%')),
b AS (SELECT policy, count(*) AS n, round(avg(reward), 4) AS mean_reward, round(avg(CASE WHEN reward > 0 THEN 1 ELSE 0 END), 4) AS pass_rate FROM p JOIN rw ON rw.action LIKE pat GROUP BY policy) SELECT *, pass_rate >= 0.9 AND n >= 50 AND mean_reward > 0 AS active FROM b"""

QUERIES = {
    "asof_nearest": as_of, "delta_snapshot": snapshot, "delta_incremental": incremental, "trace_summary": lambda s, d: E.trace_summary(traces(s, d)), "trace_running_mean": running,
    "policy_reward": lambda s, d: _rewards(s, d).drop("ts"), "policy_q_fold": q_values, "policy_replay": replay, "policy_baselines": baselines, "events_replay_state": replay_state, "events_order_violations": order_violations,
    "events_mission_status": missions, "events_retention": retention, "events_workspace_conflicts": conflicts,
}
ORACLES = {
    "asof_nearest": _AS_OF,
    "delta_snapshot": f"WITH {_SNAP} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL OUTER JOIN a ON b.o_orderkey = a.o_orderkey WHERE b.v IS DISTINCT FROM a.v",
    "delta_incremental": _INCR,
    "trace_summary": f"WITH {TRACES} SELECT coalesce(profile, 'unknown') AS profile, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS successes, count(*) FILTER (status = 'failed') AS failures, round(avg(coalesce(latency, 0)), 4) AS mean_latency, round(avg(coalesce(quality, 0)), 4) AS mean_quality, round(count(*) FILTER (status = 'succeeded') / CAST(count(*) AS DOUBLE), 4) AS success_rate FROM tr GROUP BY 1",
    "trace_running_mean": f"WITH {TRACES} SELECT event_id, CAST(CAST(sum(CAST(round(latency * 1000000) AS BIGINT)) OVER w AS BIGINT) // count(*) OVER w AS DOUBLE) / 1000000 AS running_mean, count(*) OVER w AS nth FROM tr WINDOW w AS (PARTITION BY profile ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "policy_reward": f"WITH {REWARDS} SELECT event_id, state, action, reward FROM rw", "policy_q_fold": f"WITH {QFOLD} SELECT * FROM q", "policy_replay": _REPLAY, "policy_baselines": _BASELINES,
    "events_replay_state": _STATE, "events_order_violations": _VIOLATIONS, "events_mission_status": _MISSIONS,
    "events_retention": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 5",
    "events_workspace_conflicts": "SELECT conv_id, role, count(DISTINCT sha256(text)) AS n_hashes, max(turn) AS latest_turn, count(DISTINCT sha256(text)) > 1 AS conflict FROM conversations GROUP BY conv_id, role",
}
