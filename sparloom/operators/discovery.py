"""Pages, endpoints, DDL, schedules and change checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..storage import stored


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href) of every link."""
    found = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href")).select("page_id", (F.col("pos") + 1).cast("long").alias("ord"), "href")


def endpoint_groups(observed: DataFrame) -> DataFrame:
    """Observations (url) by origin and path template: how many, and all query keys."""
    x = observed.select(U.origin(F.col("url")).alias("origin"), U.path_template(F.col("url")).alias("path_template"), U.query_keys(F.col("url")).alias("keys"))
    return x.groupBy("origin", "path_template").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))), ",").alias("query_keys"))


def ddl_fold(statements: DataFrame) -> DataFrame:
    """Tables (name, columns, indexes) after statements (ord, sql) of create table, add column and create
    index, in order."""
    s = F.lower(F.col("sql"))
    name = F.coalesce(F.nullif(F.regexp_extract(s, r"create table (?:if not exists )?([a-z_]+)", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"alter table ([a-z_]+)", 1), F.lit("")), F.regexp_extract(s, r" on ([a-z_]+)", 1))
    body = F.regexp_extract(s, r"create table [^(]*\((.*)\)", 1)
    created = F.transform(F.filter(F.split(body, r",(?![^(]*\))"), lambda c: F.trim(c) != ""), lambda c: F.element_at(F.split(F.trim(c), " "), 1))
    added = F.filter(F.array(F.regexp_extract(s, r"add column ([a-z_]+)", 1)), lambda c: c != "")
    index = F.filter(F.array(F.regexp_extract(s, r"create (?:unique )?index ([a-z_]+)", 1)), lambda c: c != "")
    rows = statements.select("ord", name.alias("name"), F.concat(created, added).alias("cols"), index.alias("idx"))
    folded = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "cols", "idx"))).alias("r"))
    return folded.select("name", F.array_join(F.array_distinct(F.flatten(F.transform("r", lambda x: x["cols"]))), ",").alias("columns"), F.array_join(F.flatten(F.transform("r", lambda x: x["idx"])), ",").alias("indexes"))


def coverage_gaps(entities: dict[str, tuple[DataFrame, str]], links: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(gap, key) for keys of each entity that its link table never names."""
    out = None
    for name, (table, key) in entities.items():
        other, column = links[name]
        part = table.select(F.col(key).alias("k")).join(other.select(F.col(column).alias("k")), "k", "left_anti").select(F.lit(f"{name} without link").alias("gap"), F.col("k").cast("long").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def waves(tasks: DataFrame, rounds: int = 50) -> DataFrame:
    """(task, wave) of (task, ord, deps, writes): a task runs after its dependencies, and two that write the
    same path never share a wave; the later one waits. A cycle is an error. Levels come from rounds over the tasks; the
    deferral is a fold in order over one level, so it is small by nature of a plan of tasks."""
    level = tasks.select("task", "ord", "deps", "writes", F.lit(0).alias("wave"))
    for _ in range(rounds):
        deps = level.select("task", "ord", F.explode_outer("deps").alias("dep"))
        need = deps.join(level.select(F.col("task").alias("dep"), F.col("wave").alias("w")), "dep", "left").groupBy("task").agg(F.max(F.coalesce(F.col("w") + 1, F.lit(0))).alias("need"))
        locked = level.select("task", "ord", "wave", F.explode_outer("writes").alias("path"))
        nth = locked.where("path IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("wave", "path").orderBy("ord")) - 1).groupBy("task").agg(F.max("k").alias("k"))
        step = level.join(need, "task").join(nth, "task", "left").select("task", "ord", "deps", "writes", F.greatest("wave", "need", F.when(F.col("k") > 0, F.col("wave") + 1).otherwise(0)).alias("new"), "wave")
        step = stored(step, "waves")
        if step.where("new <> wave").isEmpty():
            return level.select("task", "wave")
        level = step.select("task", "ord", "deps", "writes", F.col("new").alias("wave"))
    raise ValueError("tasks depend on one another in a cycle, or on more levels than rounds")


def coverage_delta(before: DataFrame, after: DataFrame, threshold: float = -0.5) -> DataFrame:
    """(metric, delta, status) of (metric, value): fail below the threshold, warn where a side lacks it."""
    b, a = before.select("metric", F.col("value").alias("b")), after.select("metric", F.col("value").alias("a"))
    delta = F.round(F.col("a") - F.col("b"), 2)
    return b.join(a, "metric", "full_outer").select("metric", delta.alias("delta"), F.when(delta.isNull(), "warn").when(delta < threshold, "fail").otherwise("pass").alias("status"))


def pair_conflicts(proposals: DataFrame) -> DataFrame:
    """(a, b, path, kind) of proposals (id, ord, reads, writes) that touch the same path."""
    touch = proposals.select("id", "ord", F.explode("reads").alias("path")).withColumn("w", F.lit(False)).unionByName(proposals.select("id", "ord", F.explode("writes").alias("path")).withColumn("w", F.lit(True))).groupBy("id", "ord", "path").agg(F.bool_or("w").alias("w"))
    x, y = touch.alias("x"), touch.alias("y")
    both = x.join(y, (F.col("x.path") == F.col("y.path")) & (F.col("x.ord") < F.col("y.ord")) & (F.col("x.w") | F.col("y.w")))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.path").alias("path"), F.when(F.col("x.w") & F.col("y.w"), "write_write").otherwise("read_write").alias("kind"))
