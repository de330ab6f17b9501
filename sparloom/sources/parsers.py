"""Sources that come as text: captured traffic, interface descriptions, diffs, diagnostics, owners, lock files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def har(captures: DataFrame, col: str = "har") -> DataFrame:
    """Observations of captured traffic in JSON: method, origin, path template, query keys, status class.
    Entries of other schemes than http are dropped."""
    kind = "struct<log:struct<entries:array<struct<request:struct<method:string,url:string>,response:struct<status:int>>>>>"
    e = captures.select(F.explode(F.from_json(col, kind)["log"]["entries"]).alias("e"))
    url = F.col("e.request.url")
    return e.where(url.rlike("^https?://")).select(F.upper("e.request.method").alias("method"), U.origin(url).alias("origin"), U.path_template(url).alias("path_template"), F.array_join(U.query_keys(url), ",").alias("query_keys"), U.status_class(F.col("e.response.status")).alias("status_class"))


def openapi(descriptions: DataFrame, col: str = "spec") -> DataFrame:
    """Observations of interface descriptions in JSON: a row for each path and method."""
    kind = "struct<paths:map<string,map<string,struct<operationId:string,parameters:array<struct<name:string,`in`:string>>>>>>"
    p = descriptions.select(F.explode(F.from_json(col, kind)["paths"]).alias("path", "methods")).select("path", F.explode("methods").alias("method", "op"))
    keys = F.array_sort(F.transform(F.filter(F.coalesce("op.parameters", F.array().cast("array<struct<name:string,in:string>>")), lambda q: q["in"] == "query"), lambda q: q["name"]))
    return p.select("path", F.upper("method").alias("method"), F.col("op.operationId").alias("operation_id"), F.array_join(keys, ",").alias("query_keys"))


def diff_hunks(diffs: DataFrame, id_col: str = "id", col: str = "diff") -> DataFrame:
    """Hunks of unified diffs; a file's header holds for the hunks after it."""
    x = diffs.select(id_col, F.posexplode(F.split(col, "\n", -1)).alias("pos", "l"))
    file = F.nullif(F.regexp_extract("l", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit(""))
    x = x.withColumn("file", F.last(file, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda k: F.regexp_extract("l", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    number = lambda k: F.when(part(k) == "", 1).otherwise(F.try_to_number(part(k), F.lit("999999999"))).cast("int")
    return x.where("l RLIKE '^@@ -'").select(id_col, "file", number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"))


def diagnostics(output: DataFrame, col: str = "text") -> DataFrame:
    """The first form that each line of a command's output has: compiler error, failed test file, or file, line and column."""
    x = output.select(F.posexplode(F.split(col, "\n", -1)).alias("pos", "l"))
    ts, fail, plain = r"^(\S+)\((\d+),(\d+)\): error (TS\d+): (.*)$", r"^\s*FAIL\s+(\S+)", r"^(\S+?):(\d+):(\d+):? (.*)$"
    g = lambda p, k: F.regexp_extract("l", p, k)
    pick = lambda a, b, c: F.when(F.col("l").rlike(ts), a).when(F.col("l").rlike(fail), b).otherwise(c)
    none = F.lit(None).cast("string")
    return x.where(F.col("l").rlike(ts) | F.col("l").rlike(fail) | F.col("l").rlike(plain)).select((F.col("pos") + 1).cast("long").alias("at"), pick(g(ts, 1), g(fail, 1), g(plain, 1)).alias("file"), pick(g(ts, 2), none, g(plain, 2)).cast("int").alias("line"), pick(g(ts, 4), F.lit("FAIL"), F.lit("message")).alias("code"))


def owners(rules: DataFrame, files: DataFrame, col: str = "text") -> DataFrame:
    """The owners of each path by prefix rules in lines of pattern and owners; all rules that match count."""
    line = rules.select(F.explode(F.split(col, "\n", -1)).alias("l")).select(F.trim(F.regexp_replace("l", "#.*$", "")).alias("l")).where("l <> ''")
    words = F.split("l", r"\s+")
    rule = line.select(F.regexp_replace(F.element_at(words, 1), r"^/|/?\**$", "").alias("at"), F.explode_outer(F.slice(words, 2, F.size(words))).alias("who")).where("who IS NOT NULL")
    # a path is joined by each folder above it, itself and none, so that rules are met by equality
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = files.select("path", F.explode(above).alias("at")).join(rule, "at", "left")
    return hit.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("who")), ",").alias("owners"))


def licences(locks: DataFrame, direct: DataFrame, col: str = "lock") -> DataFrame:
    """Packages of lock files by licence: all, and direct dependencies (name)."""
    p = locks.select(F.explode(F.from_json(col, "struct<packages:map<string,struct<version:string,license:string>>>")["packages"]).alias("key", "v")).where("key <> ''")
    named = p.select(F.regexp_replace("key", "^.*node_modules/", "").alias("name"), F.coalesce("v.license", F.lit("missing")).alias("license")).distinct()
    return named.join(direct.select("name").distinct().withColumn("d", F.lit(1)), "name", "left").groupBy("license").agg(F.count("*").alias("packages"), F.count("d").alias("direct"))
