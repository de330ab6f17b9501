"""Which sources go into a context, and which records a budget keeps.

A budget is filled greedily in order of priority: what does not fit is passed over and what comes later may still fit.
No list of rows is gathered. Rows are dealt out by ranges of the order once; each step finds, by prefix sums over the
ranges, the first row at which what is left falls to half or less, so that there are no more steps than the budget has
binary digits. What was kept between two such rows follows from their places. Survey rows: SCH-09, EVT-06, WIN-06.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..storage import stored
from .repo import file_of
from .reviews import authority, authority_score
from .search import query_tokens

#: Files found by the query, and sources in all.
QUERY_FILES, SOURCES = 6, 10


def fill(rows: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """The rows with kept: whether a greedy fill of the budget in this order takes them. The first row is always kept.
    Of rows equal in the order any may come first; sizes are 0 or more."""
    placed = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = stored(placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "ranges")
    at = F.struct("_range", "_nth")
    first = placed.select(F.min(F.struct("_range", "_nth", size)).alias("m")).first()["m"]
    if first is None:
        return placed.drop("_range", "_nth").withColumn("kept", F.lit(False))
    here = lambda p: F.struct(F.lit(p[0]).alias("_range"), F.lit(p[1]).alias("_nth"))
    kept, start, left = at == here(first[:2]), first[:2], budget - first[2]
    while left >= 0:
        open_ = placed.where((at > here(start)) & (F.col(size) <= left)).withColumn("_small", 2 * F.col(size) <= left)
        sums = open_.groupBy("_range").agg(F.coalesce(F.sum(F.when(F.col("_small"), F.col(size))), F.lit(0)).alias("s"), F.count("*").alias("n")).collect()  # a row for each range
        if not sums:
            break
        before, total, last = {}, 0, None
        for r in sorted(sums):
            before[r["_range"]], total = total, total + r["s"]
            last = r["_range"]
            if total > left:
                break
        base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range"))
        w = Window.partitionBy("_range").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
        so_far = base + F.coalesce(F.sum(F.when(F.col("_small"), F.col(size))).over(w), F.lit(0))
        run = open_.where(F.col("_range") <= last).withColumn("_sum", so_far)
        # a small row that no longer fits, or a large one that does
        event = F.when(F.col("_small"), F.col("_sum") > left).otherwise(F.col("_sum") + F.col(size) <= left)
        hit = run.where(event).select(F.min(F.struct("_range", "_nth", "_small", "_sum", size)).alias("m")).first()["m"]
        small = 2 * F.col(size) <= left
        if hit is None:
            kept = kept | ((at > here(start)) & small)
            break
        stop = hit[:2]
        kept = kept | ((at > here(start)) & (at < here(stop)) & small)
        if not hit["_small"]:
            kept = kept | (at == here(stop))
        left -= hit["_sum"] - hit[4] if hit["_small"] else hit["_sum"] + hit[4]
        start = stop
    return placed.withColumn("kept", kept).drop("_range", "_nth")


def budget_review(records: DataFrame, q: str, budget: int, pinned: DataFrame, stale: DataFrame, changed: DataFrame) -> DataFrame:
    """id, source, reason, priority, chars, kept of records (id, source, text, recorded). Stale ones are never kept;
    pinned, changed (source) and matching ones come in this order, then by authority, the latest first."""
    tokens = sorted(set(query_tokens(q)), key=query_tokens(q).index)
    hay = F.lower(F.concat_ws(" ", "source", "text"))
    score = sum((F.when(F.contains(hay, F.lit(t)), query_tokens(q).count(t)).otherwise(0) for t in tokens), F.lit(0))
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    x = records.join(mark(pinned, "p"), "id", "left").join(mark(stale, "s"), "id", "left").join(changed.select("source").distinct().withColumn("c", F.lit(True)), "source", "left")
    own = authority_score(authority(F.col("source")))
    priority = F.when(F.col("p"), 1000).otherwise(0) + F.when(F.col("c"), 100).otherwise(0) + score * 10 + own - F.when(F.col("s"), 10_000).otherwise(0)
    reason = F.when(F.col("s"), "stale").when(F.col("p"), "pinned").when(F.col("c"), "changed_file").otherwise("query_match")
    scored = stored(x.where((score > 0) | F.col("p") | F.col("s") | F.col("c")).select("id", "source", reason.alias("reason"), priority.cast("double").alias("priority"), F.length("text").cast("long").alias("chars"), "recorded"), "scored")
    kept = fill(scored.where("reason <> 'stale'"), [F.desc("priority"), F.desc("recorded"), F.asc("source"), F.asc("id")], "chars", budget)
    out = kept.withColumn("reason", F.when(F.col("kept"), F.col("reason")).otherwise("budget")).unionByName(scored.where("reason = 'stale'").withColumn("kept", F.lit(False)))
    return out.select("id", "source", "reason", "priority", "chars", "kept")


def select_sources(files: DataFrame, edges: DataFrame, changed: DataFrame, preferred: DataFrame, reached: DataFrame, q: str, limit: int = SOURCES) -> DataFrame:
    """place, path, reason of the sources of a context: changed files (path), what they import, call or refer to,
    preferred ones (path), what the change reaches (kind, node), its tests, and the files that fit the query best. A
    path counts where it comes first; within a reason paths are in order, those of the query by score."""
    own = changed.select("path").distinct()
    near = edges.where("kind IN ('imports', 'calls', 'references')").select(file_of(F.col("src")).alias("from"), file_of(F.col("dst")).alias("path")).where("path IS NOT NULL AND from <> path")
    near = near.join(own.select(F.col("path").alias("from")), "from", "left_semi")
    tokens = query_tokens(q)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    score = sum((F.when(F.contains(low(F.col("path")), F.lit(t)), 2).otherwise(0) + F.when(F.contains(low(F.col("content")), F.lit(t)), 1).otherwise(0) for t in tokens), F.lit(0))
    found = files.select("path", score.alias("score"), authority_score(authority(F.col("path"))).alias("own")).where("score > 0").orderBy(F.desc("score"), F.desc("own"), "path").limit(QUERY_FILES)
    listed = lambda df, nth, reason: df.select(F.lit(nth).alias("nth"), F.lit(0.0).alias("rank"), F.lit(0.0).alias("own"), "path", F.lit(reason).alias("reason"))
    node = lambda kind: reached.where(F.col("kind") == kind).select(F.col("node").alias("path"))
    every = listed(own, 0, "changed").unionByName(listed(near, 1, "neighbour")).unionByName(listed(preferred, 2, "preferred")).unionByName(listed(node("file"), 3, "impacted")).unionByName(listed(node("test"), 4, "test"))
    every = every.unionByName(found.select(F.lit(5).alias("nth"), (-F.col("score")).cast("double").alias("rank"), (-F.col("own")).cast("double").alias("own"), "path", F.lit("query").alias("reason")))
    once = every.groupBy("path").agg(F.min(F.struct("nth", "rank", "own", "reason")).alias("r")).join(files.select("path"), "path", "left_semi")
    top = once.select("r.*", "path").orderBy("nth", "rank", "own", "path").limit(limit)
    # a context's few sources
    return top.select(F.row_number().over(Window.orderBy("nth", "rank", "own", "path")).alias("place"), "path", "reason")
