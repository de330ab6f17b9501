"""Paths between facts, and what a change reaches over as many hops as asked for.

A search goes level by level; each level is a written table, joined to the edges by node and reduced to one route for
each (start, node) before the next. Survey rows: IMP-02, IMP-03, IMP-06, JN-07, GRF-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..storage import stored
from .graph import PROVENANCE_WEIGHT, provenance_weight
from .repo import file_of, tests_of

# Confidence of a test by relation, and of what is reached by an inferred edge.
RELATION_TEST, INFERRED = 0.95, 0.6
#: Kinds of edges that carry a change from their target to their source.
CARRY = ("imports", "references", "calls", "tests")


def label(src: str = "src", kind: str = "kind", dst: str = "dst") -> Column:
    return F.concat(src, F.lit(" -"), kind, F.lit("-> "), dst)


def _levels(edges: DataFrame, start: DataFrame, depth: int, direction: str, by_start: bool) -> Iterator[DataFrame]:
    """The written rows of each level of ``routes``, level by level, up to the last that has any."""
    w, text = provenance_weight(F.col("provenance")), label()
    one = lambda a, b: edges.select(F.col(a).alias("at"), F.col(b).alias("to"), text.alias("step"), w.alias("w"), "confidence", (F.col("provenance") == "inferred").alias("inf"))
    e = {"outbound": lambda: one("src", "dst"), "inbound": lambda: one("dst", "src"), "both": lambda: one("src", "dst").unionByName(one("dst", "src"))}[direction]()
    e = stored(e.where("at <> `to`"), "steps")
    key = ["start", "node"] if by_start else ["node"]
    first = F.col("node") if by_start else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    front = stored(start.select(first.alias("start"), "node", F.lit(0).alias("hops"), none.alias("route"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("sure"), F.lit(False).alias("inferred")).distinct(), "front")
    seen = front.select(*key)
    for k in range(1, depth + 1):
        near = front.join(e, front["node"] == e["at"]).select("start", F.col("to").alias("node"), F.concat("route", F.array("step")).alias("route"), (F.col("weight") + F.col("w")).alias("weight"), F.when(F.col("hops") == 0, F.col("confidence")).otherwise(F.col("sure")).alias("sure"), F.when(F.col("hops") == 0, F.col("inf")).otherwise(F.col("inferred")).alias("inferred"))
        best = near.groupBy(*key).agg(F.min(F.struct("route", "start", "weight", "sure", "inferred")).alias("r"))
        new = best.join(seen, key, "left_anti")
        front = stored(new.select("r.start", "node", F.lit(k).alias("hops"), "r.route", "r.weight", "r.sure", "r.inferred"), "front")
        yield front
        seen = seen.unionByName(front.select(*key))
        if front.isEmpty():
            break


def routes(edges: DataFrame, start: DataFrame, depth: int, direction: str = "outbound", by_start: bool = True) -> DataFrame:
    """start, node, hops, route (labels of its edges), weight (sum of their provenance's), sure (the first edge's
    confidence), inferred (whether that is inferred) of all that is reached from start (node) in 1 to depth hops. Of the
    shortest routes to a node the first by its labels counts: from each start, or from any of them. Edges have src, dst,
    kind, provenance, confidence."""
    return reduce(DataFrame.unionByName, _levels(edges, start, depth, direction, by_start))


def score(weight: Column, hops: Column) -> Column:
    """Mean weight of provenance, over the hops."""
    return F.round(weight / hops / hops, 4)


def paths(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = 2, direction: str = "both", kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
    """start, goal, hops, score, route: scored paths from start to goal nodes (node), the best first. depth and limit are
    kept within 1 to 8 and 1 to 100. No path of k hops scores above 1 / k, and of equal scores fewer hops come first:
    once limit paths score at least what the next level can, the further levels can't change the result and aren't
    walked."""
    some = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    depth, limit, best = max(1, min(8, depth)), max(1, min(100, limit)), None
    for k, front in enumerate(_levels(some, start, depth, direction, True), 1):
        found = front.join(goal.select("node"), "node", "left_semi")
        scored = found.select("start", F.col("node").alias("goal"), "hops", score(F.col("weight"), F.col("hops")).alias("score"), F.array_join("route", " | ").alias("route"))
        whole = scored if best is None else best.unionByName(scored)
        best = stored(whole.orderBy(F.desc("score"), "hops", "start", "goal").limit(limit), "best")
        if best.where(F.col("score") >= F.round(F.lit(max(PROVENANCE_WEIGHT.values()) / (k + 1)), 4)).count() == limit:
            break
    return best.orderBy(F.desc("score"), "hops", "start", "goal")


def changed_symbols(found: DataFrame, changed: DataFrame, hunks: DataFrame | None = None) -> DataFrame:
    """Symbols of changed files (path); of a file with hunks (file, new_start, new_lines), those on their lines (JN-07).
    Hunks meet symbols by file; a file's own are few."""
    own = found.join(changed.select("path"), "path", "left_semi")
    if hunks is None:
        return own
    h = hunks.select(F.col("file").alias("path"), "new_start", F.greatest(F.lit(1), "new_lines").alias("n"))
    inside = own.join(h, "path").where("line >= new_start AND line <= new_start + n - 1").select(own.columns).distinct()
    return inside.unionByName(own.join(h.select("path"), "path", "left_anti"))


def impact(files: DataFrame, found: DataFrame, edges: DataFrame, changed: DataFrame, hunks: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """kind (symbol, file, test), node, hops, confidence, route of what a change of files (path) reaches against the
    edges that carry it, in up to depth hops. A file a hop away has its edge's confidence, or INFERRED; one further off
    the path's score, INFERRED at least. Tests are also those that name a changed symbol or file."""
    symbols = stored(changed_symbols(found, changed, hunks), "changed")
    start = changed.select(F.col("path").alias("node")).unionByName(symbols.select(F.col("id").alias("node")))
    reached = routes(edges.where(F.col("kind").isin(*CARRY)), start, depth, "inbound", by_start=False)
    at = reached.withColumn("path", file_of(F.col("node"))).where("path IS NOT NULL").join(changed.select("path"), "path", "left_anti")
    near = F.when(F.col("inferred"), INFERRED).otherwise(F.col("sure"))
    confidence = F.when(P.is_test(F.col("path")), RELATION_TEST).when(F.col("hops") == 1, near).otherwise(F.greatest(F.lit(INFERRED), score(F.col("weight"), F.col("hops"))))
    kind = F.when(P.is_test(F.col("path")), "test").otherwise("file")
    by_edge = at.select(kind.alias("kind"), F.col("path").alias("node"), "hops", confidence.alias("confidence"), F.array_join("route", " | ").alias("route"))
    named = tests_of(files, symbols, changed).join(changed.select(F.col("path").alias("test")), "test", "left_anti")
    by_name = named.select(F.lit("test").alias("kind"), F.col("test").alias("node"), F.lit(None).cast("int").alias("hops"), "confidence", F.lit("").alias("route"))
    # the surest, then the nearest, then the first route
    order = F.struct((-F.col("confidence")).alias("c"), F.coalesce("hops", F.lit(99)).alias("h"), "route", "hops", "confidence")
    first = by_edge.unionByName(by_name).groupBy("kind", "node").agg(F.min(order).alias("r"))
    own = symbols.select(F.lit("symbol").alias("kind"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("confidence"), F.lit("").alias("route"))
    return own.unionByName(first.select("kind", "node", "r.hops", "r.confidence", "r.route"))


def risk(reached: DataFrame) -> DataFrame:
    """One row: files, tests, risk of an ``impact``. high without tests or with more than five files, medium with any."""
    n = reached.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "test").alias("tests"))
    return n.withColumn("risk", F.when((F.col("tests") == 0) | (F.col("files") > 5), "high").when(F.col("files") > 0, "medium").otherwise("low"))


def blast_radius(edges: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """kind, name, hops, n: files, tests, entrypoints and modules that hang on targets (node, files or symbols). An
    entrypoint is a reached file that no other file imports; a module is as near as its nearest file."""
    carried = edges.where(F.col("kind").isin(*CARRY))
    reached = routes(carried, targets, depth, "inbound", by_start=False)
    own = targets.select(file_of(F.col("node")).alias("path")).distinct()
    files = stored(reached.withColumn("path", file_of(F.col("node"))).where("path IS NOT NULL").join(own, "path", "left_anti").groupBy("path").agg(F.min("hops").alias("hops"), F.count("*").alias("n")), "radius")
    imported = carried.where("kind = 'imports'").select(F.col("dst").alias("path")).distinct()
    test = P.is_test(F.col("path"))
    out = files.select(F.when(test, "test").otherwise("file").alias("kind"), F.col("path").alias("name"), "hops", "n")
    entry = files.where(~test).join(imported, "path", "left_anti").select(F.lit("entrypoint").alias("kind"), F.col("path").alias("name"), "hops", "n")
    modules = files.groupBy(P.module_root(F.col("path")).alias("name")).agg(F.min("hops").alias("hops"), F.sum("n").alias("n")).select(F.lit("module").alias("kind"), "name", "hops", "n")
    return out.unionByName(entry).unionByName(modules)
