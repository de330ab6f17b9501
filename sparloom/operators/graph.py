"""Graph operators over edges (src, dst, kind, provenance, confidence).

The iterative ones write each round to the shared folder, so that lineage stays short and a lost
executor costs no more than a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored as written

# Weights of provenance in path scores.
PROVENANCE_WEIGHT = {"extracted": 1.0, "derived": 0.8, "inferred": 0.6}
OTHER_PROVENANCE = 0.4
#: Edges from which the rounds of strongly connected components send nothing whole through the driver.
MERGED_EDGES = 100_000


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """in_degree, out_degree and their sum of every endpoint, and of listed nodes without edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def hubs_and_bridges(edges: DataFrame, k: int = 10) -> DataFrame:
    """role, node, score: the k largest degrees, and the k largest products of in and out degree."""
    d = degrees(edges)
    hubs = d.orderBy(F.desc("degree"), "node").limit(k).select(F.lit("hub").alias("role"), "node", F.col("degree").alias("score"))
    bridges = d.where("in_degree > 0 AND out_degree > 0").select(F.lit("bridge").alias("role"), "node", (F.col("in_degree") * F.col("out_degree")).alias("score")).orderBy(F.desc("score"), "node").limit(k)
    return hubs.unionByName(bridges)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): plain undirected components, named by their smallest node."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both, "edges")
    now = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("component")).withColumnRenamed("src", "node")
    now = written(now, "labels")
    for _ in range(rounds):
        seen = both.join(now, both["dst"] == now["node"]).groupBy("src").agg(F.min("component").alias("near"))
        step = now.join(seen, now["node"] == seen["src"], "left").select("component", F.least("component", F.coalesce("near", "component")).alias("near"))
        # a whole label goes over to the smallest one beside it
        moves = written(step.groupBy("component").agg(F.min("near").alias("to")).where("`to` <> component"), "moves")
        if moves.isEmpty():
            return now
        moves = _ends(moves)
        now = written(now.join(moves, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _ends(moves: DataFrame) -> DataFrame:
    """moves (component, to), each with the label at the end of its chain. Moves go to smaller labels, so that chains end;
    each round doubles how far a move sees, so that a chain of n moves takes log n rounds."""
    while True:
        far = moves.select(F.col("component").alias("at"), F.col("to").alias("further"))
        new = written(moves.join(far, moves["to"] == far["at"], "left").select("component", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("open")), "moves")
        if new.where("open").isEmpty():
            return new.select("component", "to")
        moves = new.select("component", "to")


def hops(edges: DataFrame, start: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(node, hops) of what is reached from start (node) in up to depth hops, start included."""
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = front = written(start.select("node").distinct().withColumn("hops", F.lit(0).cast("long")), "front")
    for k in range(1, depth + 1):
        # the frontier is a written table, so that its size is known and a small one is broadcast
        front = e.join(front, e["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k).cast("long"))
        front = written(front, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reached(edges: DataFrame, start: DataFrame, near: int = 8, rounds: int = 1000) -> DataFrame:
    """(node) of all that start (node) leads to, start included, at any depth.

    After a few hops, nodes are taken out of what is left, many at a time and no two beside each other; their edges
    are replaced by edges from those before to those behind. What lies before such a node then tells whether it is
    reached, in the reverse order. So a long chain takes rounds by the logarithm of its length. Where taking out
    nodes doesn't shrink the edges any more, the rest is walked hop by hop."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    seen = hops(e, start, near).select("node")
    past = lambda df, end, known: df.join(known.select(F.col("node").alias(end)), end, "left_anti")
    fresh = past(e, "dst", seen)
    front = written(fresh.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "front")
    if front.isEmpty():
        return seen
    e = written(past(past(fresh, "src", seen), "dst", front).select("src", "dst"), "rest")
    n, levels = e.count(), []
    for k in range(rounds):
        if not n:
            break
        ends = degrees(e).where("in_degree * out_degree <= degree + 2").select("node", F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node").alias("turn"))
        ends = written(ends, "ends")
        a, b = (ends.select(F.col("node").alias(end), F.col("turn").alias("turn_" + end)) for end in ("src", "dst"))
        both = e.join(a, "src").join(b, "dst")
        later = both.select(F.when(F.col("turn_src") < F.col("turn_dst"), F.col("dst")).otherwise(F.col("src")).alias("node"))
        out = written(past(ends, "node", later).select("node"), "out")
        at = lambda end: out.select(F.col("node").alias(end), F.lit(True).alias("out_" + end))  # noqa: B023, E731
        marked = written(e.join(at("src"), "src", "left").join(at("dst"), "dst", "left"), "marked")
        into, onward = marked.where("out_dst").select("src", "dst"), marked.where("out_src").select("src", "dst")
        over = into.select("src", F.col("dst").alias("via")).join(onward.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src <> dst")
        # what a reached node leads to is reached
        started = front.join(out, "node", "left_semi").select(F.col("node").alias("src"))
        grown = written(front.unionByName(onward.join(started, "src", "left_semi").select(F.col("dst").alias("node"))).distinct(), "front")
        left = written(marked.where("out_src IS NULL AND out_dst IS NULL").select("src", "dst").unionByName(over).distinct(), "rest")
        m = left.count()
        if m > 0.98 * n:
            break
        levels.append(into)
        e, front, n = left, grown, m
    while n:
        new = written(past(e.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "node", front), "front")
        if new.isEmpty():
            break
        front = written(front.unionByName(new), "front")
    for into in reversed(levels):
        front = written(front.unionByName(into.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))).distinct(), "front")
    return seen.unionByName(front)


def _by_shuffle(df: DataFrame, large: bool) -> DataFrame:
    """The table, joined by shuffle where it is large: packed files look small enough to broadcast in every round."""
    return df.hint("merge") if large else df


def _spread(edges: DataFrame, now: DataFrame, rounds: int, large: bool = False) -> DataFrame:
    """(node, mark) with the smallest mark that any node leading to a node has, its own included."""
    edges = _by_shuffle(edges, large)
    for _ in range(rounds):
        got = edges.join(now, edges["src"] == now["node"]).groupBy("dst").agg(F.min("mark").alias("got"))
        new = written(now.join(_by_shuffle(got, large), now["node"] == got["dst"], "left").select("node", F.least("mark", F.coalesce("got", "mark")).alias("mark"), (F.col("got") < F.col("mark")).alias("less")), "marks")
        now = new.select("node", "mark")
        if new.where("less").isEmpty():
            return now
    raise RuntimeError(f"marks didn't settle in {rounds} rounds")


def strongly_connected(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, scc) of nodes in a cycle of at least two: those that reach one another, named by the smallest.

    Nodes without edges both ways are trimmed off. Each node gets the smallest node that leads to it as its
    colour; what leads back to that node within the colour is its component, and is taken out. Rows stay linear
    in the edges."""
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "core")
    found, first = None, e.count()
    for _ in range(rounds):
        n = e.count()
        if not n:
            break
        large = n > MERGED_EDGES
        ends = lambda a, b: _by_shuffle(e.select(F.col(a).alias(b)).distinct(), large)  # noqa: B023, E731
        trimmed = written(e.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"), "core")
        if trimmed.count() < n:
            e = trimmed
            continue
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colours = _spread(e, nodes.withColumn("mark", F.col("node")), rounds, large)
        a, b = (_by_shuffle(colours.select(F.col("node").alias(end), F.col("mark").alias(c)), large) for end, c in (("src", "ca"), ("dst", "cb")))
        back = written(e.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        # 0 at the colour's own node spreads against the edges
        led = _spread(back, colours.select("node", F.when(F.col("node") == F.col("mark"), 0).otherwise(1).alias("mark")), rounds, large)
        own = written(colours.select("node", F.col("mark").alias("scc")).join(_by_shuffle(led.where("mark = 0").select("node"), large), "node"), "scc")
        found = own if found is None else found.unionByName(own)
        gone = lambda end: _by_shuffle(own.select(F.col("node").alias(end)), large)  # noqa: B023, E731
        e = written(e.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), "core")
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    several = found.groupBy("scc").count().where("count > 1").select("scc")
    return found.join(_by_shuffle(several, first > MERGED_EDGES), "scc", "left_semi").select("node", "scc")


def provenance_weight(c: Column) -> Column:
    out = F.lit(OTHER_PROVENANCE)
    for name, w in PROVENANCE_WEIGHT.items():
        out = F.when(c == name, w).otherwise(out)
    return out


def surprising(edges: DataFrame, communities: DataFrame, k: int = 20) -> DataFrame:
    """Edges between communities (node, community), the most surprising first."""
    d = degrees(edges).select("node", "degree", ((F.col("in_degree") > 0) & (F.col("out_degree") > 0)).alias("bridge"))
    c = communities.join(d, "node")
    a, b = c.select([F.col(x).alias(f"{x}_a") for x in c.columns]), c.select([F.col(x).alias(f"{x}_b") for x in c.columns])
    both = edges.join(a, edges["src"] == a["node_a"]).join(b, edges["dst"] == b["node_b"]).where("community_a <> community_b")
    score = F.lit(100.0) + F.col("degree_a") + F.col("degree_b") + 10 * F.col("confidence") + F.when(F.col("provenance") == "extracted", 8).when(F.col("provenance") == "inferred", 4).otherwise(1) + F.when(F.col("bridge_a") | F.col("bridge_b"), 10).otherwise(0)
    return both.select("src", "dst", "kind", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "src", "dst", "kind").limit(k)


def between(edges: DataFrame, direction: str, src: list[str] | None = None, dst: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose ends are as asked for; inbound swaps them where src is given, both takes either way."""
    f = F.lit(True) if src is None else F.col("src").isin(src)
    t = F.lit(True) if dst is None else F.col("dst").isin(dst)
    rf = F.lit(True) if src is None else F.col("dst").isin(src)
    rt = F.lit(True) if dst is None else F.col("src").isin(dst)
    test = {"outbound": f & t, "inbound": (rf & rt) if src is not None else t, "both": (f & t) | (rf & rt)}[direction]
    out = edges.where(test)
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page by a total order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 100))
