"""Event logs, traces, policies and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_cols: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before it. A union in one
    order instead of a range join: the work is linear in the rows of a key, however many."""
    cols = left.columns
    a = left.select(*cols, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), *[F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_{c}") for c in right_cols])
    b = right.select(*[F.col(key).alias(c) if c == key else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in cols], F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_{c}") for c in right_cols])
    w = Window.partitionBy(key).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(f"_{c}", ignorenulls=True).over(w).alias(f"right_{c}") for c in right_cols]
    return a.unionByName(b).select("*", *last).where("_side = 1").drop("_ts", "_side", *[f"_{c}" for c in right_cols])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (added, deleted, modified) between two snapshots."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def incremental(old: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Derived rows of unchanged keys kept, those of changed keys replaced; equal to a full rebuild."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def trace_summary(traces: DataFrame) -> DataFrame:
    """Per profile of (profile, status, latency, quality): runs, outcomes and means."""
    return traces.groupBy(F.coalesce("profile", F.lit("unknown")).alias("profile")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "succeeded").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.round(F.avg(F.coalesce("latency", F.lit(0.0))), 4).alias("mean_latency"), F.round(F.avg(F.coalesce("quality", F.lit(0.0))), 4).alias("mean_quality"),
        F.round(F.count_if(F.col("status") == "succeeded") / F.count("*"), 4).alias("success_rate"),
    )


def running_mean(traces: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """The mean so far, cut to millionths; summed in millionths, so that it doesn't hang on the order of additions."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = traces.withColumn("_sum", F.sum(F.round(F.col(value) * 1000000).cast("long")).over(w)).withColumn("nth", F.count("*").over(w))
    return summed.withColumn("running_mean", F.expr("_sum div nth") / 1000000).drop("_sum")


def reward(passed: Column, evidence: Column, reasoning: Column, questions: Column, corrections: Column, ms: Column, tokens: Column) -> Column:
    """The reward of one outcome, to four places."""
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(reasoning, F.lit(0.0))))
    return F.round(
        F.when(passed, 10.0).otherwise(-8.0) + 0.5 * F.least(evidence, F.lit(6)) + 2 * clip - 0.8 * F.least(questions, F.lit(10)) - 1.2 * F.least(corrections, F.lit(10)) - F.least(ms / 60000, F.lit(4.0)) - F.least(tokens / 50000, F.lit(4.0)), 4
    )


def q_fold(rewards: Column, rate: float = 0.3, epochs: int = 4) -> Column:
    """The value after all rewards have been learned, in order, so many times; six places each step."""
    return F.aggregate(F.flatten(F.array_repeat(rewards, epochs)), F.lit(0.0), lambda q, r: F.round(q + rate * (r - q), 6))


def best_action(values: DataFrame, state: str, action: str, value: str, tie: str = "min") -> DataFrame:
    """The action of the highest value for each state; ties by the smallest or the largest name."""
    order = [F.desc(value), F.asc(action) if tie == "min" else F.desc(action)]
    return values.withColumn("_k", F.row_number().over(Window.partitionBy(state).orderBy(*order))).where("_k = 1").select(state, F.col(action).alias("best"), F.col(value).alias("best_value"))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
