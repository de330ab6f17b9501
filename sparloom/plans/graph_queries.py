"""Graph, relation and impact queries, bound to the order tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..sources.tables import table


def edges(spark: SparkSession, d: str) -> DataFrame:
    """customer -places-> order -contains-> part -supplied_by-> supplier -located_in-> nation -part_of-> region."""
    T = lambda n: table(spark, d, n)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    sure = [F.lit("extracted").alias("provenance"), F.lit(1.0).alias("confidence")]
    kind = lambda k: F.lit(k).alias("kind")
    prov = F.when(F.col("l_returnflag") == "A", "extracted").when(F.col("l_returnflag") == "N", "inferred").otherwise("ambiguous").alias("provenance")
    li = T("lineitem")
    parts = [
        T("orders").select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst"), kind("places"), *sure),
        li.select(node("order", "l_orderkey").alias("src"), node("part", "l_partkey").alias("dst"), kind("contains"), prov, (1 - F.col("l_discount")).alias("confidence")),
        li.select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst")).distinct().select("src", "dst", kind("supplied_by"), *sure),
        T("supplier").select(node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst"), kind("located_in"), *sure),
        T("customer").select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst"), kind("located_in"), *sure),
        T("nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"), kind("part_of"), *sure),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """edges AS (
  SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'places' AS kind, 'extracted' AS provenance, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', CASE l_returnflag WHEN 'A' THEN 'extracted' WHEN 'N' THEN 'inferred' ELSE 'ambiguous' END, 1 - l_discount FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', 'extracted', 1.0::DOUBLE FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'extracted', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'extracted', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 'extracted', 1.0::DOUBLE FROM nation)"""
DEGREES = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node)"


def report(spark, d):
    """Edges by kind and provenance, with mean confidence and the busiest source."""
    e = edges(spark, d)
    top = e.groupBy("kind", "src").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "src"))).where("k = 1").select("kind", F.col("src").alias("top_src"), F.col("n").alias("top_out"))
    counts = e.groupBy("kind").agg(F.count("*").alias("n_edges"), *[F.count_if(F.col("provenance") == p).alias(f"n_{p}") for p in ("extracted", "inferred", "ambiguous")], F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return counts.join(top, "kind")


def orphans(spark, d):
    """Customers without an order, parts and suppliers on no line."""
    T = lambda n: table(spark, d, n)
    none = lambda a, k, b, j, kind: T(a).join(T(b).select(F.col(j).alias(k)), k, "left_anti").select(F.lit(kind).alias("kind"), F.col(k).cast("long").alias("key"))
    return none("customer", "c_custkey", "orders", "o_custkey", "customer").unionByName(none("part", "p_partkey", "lineitem", "l_partkey", "part")).unionByName(none("supplier", "s_suppkey", "lineitem", "l_suppkey", "supplier"))


def _shared_lines(spark, d) -> DataFrame:
    """Edges from the first document of a line to the others that have it, for lines of 20 characters."""
    x = X.lines(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.trim("line_text").alias("l")).where("length(l) >= 20").distinct()
    first = x.groupBy("l").agg(F.min("doc_id").alias("src"))
    return x.join(first, "l").where("doc_id <> src").select("src", F.col("doc_id").alias("dst")).distinct()


_SHARED = """x AS (SELECT DISTINCT doc_id, trim(l) AS l FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 20),
sh AS (SELECT DISTINCT f.src, x.doc_id AS dst FROM x JOIN (SELECT l, min(doc_id) AS src FROM x GROUP BY l) f ON x.l = f.l WHERE x.doc_id <> f.src)"""
_COMPONENTS = f"""WITH RECURSIVE {_SHARED}, e AS (SELECT src, dst FROM sh UNION SELECT dst, src FROM sh),
r AS (SELECT DISTINCT src AS node, src AS reach FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON r.reach = e.src)
SELECT node, min(reach) AS component FROM r GROUP BY node"""


def component_table(spark, d):
    return G.components(_shared_lines(spark, d))


def community_records(spark, d):
    """One row for each component: a name from its members, their number and the busiest."""
    e = _shared_lines(spark, d)
    c = G.components(e)
    deg = G.degrees(e).select("node", "degree")
    members = F.array_sort(F.collect_set(F.col("node")))
    return c.join(deg, "node").groupBy("component").agg(F.substring(F.sha2(F.array_join(F.transform(members, lambda x: x.cast("string")), "\n"), 256), 1, 12).alias("community_id"), F.count("*").alias("n_members"), F.max_by("node", F.struct("degree", F.negate("node"))).alias("busiest"))


_RECORDS = _COMPONENTS.replace("SELECT node, min(reach) AS component FROM r GROUP BY node", """, c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM sh UNION ALL SELECT dst FROM sh) GROUP BY node)
SELECT component, substr(sha256(string_agg(CAST(c.node AS VARCHAR), chr(10) ORDER BY c.node)), 1, 12) AS community_id, count(*) AS n_members, first(c.node ORDER BY degree DESC, c.node) AS busiest FROM c JOIN g ON c.node = g.node GROUP BY component""").replace("GROUP BY node)\n, c AS", "GROUP BY node),\nc AS").replace("ON r.reach = e.src)\n, c AS", "ON r.reach = e.src),\nc AS")


def _regions(spark, d) -> DataFrame:
    """Nations, suppliers and customers with their region as community."""
    T = lambda n: table(spark, d, n)
    n = T("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("community"))
    s = T("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"), "community")
    p = T("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), (F.col("p_partkey") % 5).alias("community"))
    return s.unionByName(p)


def surprising(spark, d):
    return G.surprising(edges(spark, d).where("kind IN ('supplied_by', 'located_in')"), _regions(spark, d))


_SURPRISING = f"""WITH {EDGES.replace('edges AS', 'all_edges AS')}, edges AS (SELECT * FROM all_edges WHERE kind IN ('supplied_by', 'located_in')), {DEGREES},
c AS (SELECT 'supplier:' || s_suppkey AS node, n_regionkey::BIGINT AS community FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'part:' || p_partkey, p_partkey % 5 FROM part)
SELECT src, dst, kind, round(100.0 + a.degree + b.degree + 10 * confidence + CASE provenance WHEN 'extracted' THEN 8 WHEN 'inferred' THEN 4 ELSE 1 END + CASE WHEN (a.in_degree > 0 AND a.out_degree > 0) OR (b.in_degree > 0 AND b.out_degree > 0) THEN 10 ELSE 0 END, 4) AS score
FROM edges e JOIN c ca ON e.src = ca.node JOIN c cb ON e.dst = cb.node JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst WHERE ca.community <> cb.community ORDER BY score DESC, src, dst, kind LIMIT 20"""


def bfs_path(spark, d):
    """Hops from one customer along edges of any direction, three at most, without the line items."""
    e = edges(spark, d).where("kind IN ('places', 'located_in', 'part_of')")
    return G.hops(e, spark.createDataFrame([("customer:1",)], "node string"), 3, directed=False)


_BFS = f"""WITH RECURSIVE {EDGES}, e AS (SELECT src, dst FROM edges WHERE kind IN ('places', 'located_in', 'part_of') UNION SELECT dst, src FROM edges WHERE kind IN ('places', 'located_in', 'part_of')),
r AS (SELECT 'customer:1' AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM r JOIN e ON r.node = e.src WHERE hops < 3)
SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY node"""


def downstream(spark, d):
    """What lies within three hops below the first ten customers."""
    start = table(spark, d, "customer").where("c_custkey <= 10").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return G.hops(edges(spark, d), start, 3).where("hops > 0")


_DOWN = f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT 'customer:' || c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey <= 10 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON r.node = e.src WHERE hops < 3)
SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY node HAVING min(hops) > 0"""

def relation_page(spark, d):
    """The second page of edges into one nation, and out of it."""
    return G.page(G.between(edges(spark, d), "both", src=["nation:1"]), ["src", "dst", "kind"], 10, 25)


_PAGE = f"WITH {EDGES} SELECT * FROM edges WHERE src = 'nation:1' OR dst = 'nation:1' ORDER BY src, dst, kind LIMIT 25 OFFSET 10"


def path_score(spark, d):
    """Customer to region in two hops: mean weight of provenance over hops."""
    e = edges(spark, d).where("kind IN ('located_in', 'part_of')")
    a, b = e.alias("a"), e.alias("b")
    w = G.provenance_weight
    return a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src LIKE 'customer:%'").select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), F.round((w(F.col("a.provenance")) + w(F.col("b.provenance"))) / 2 / 2, 4).alias("score"))


def blast_radius(spark, d):
    """What points at the suppliers of a nation: the surest confidence, the reasons and how many."""
    e = edges(spark, d)
    hit = table(spark, d, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
    one = e.join(hit, e["dst"] == hit["node"]).select(F.col("src").alias("node"), F.lit("direct").alias("reason"), "confidence")
    two = e.join(one.select(F.col("node").alias("mid")).distinct(), e["dst"] == F.col("mid")).select(F.col("src").alias("node"), F.lit("through part").alias("reason"), (F.col("confidence") * 0.5).alias("confidence"))
    return one.unionByName(two).groupBy("node").agg(F.round(F.max("confidence"), 4).alias("confidence"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count("*").alias("n"))


_BLAST = f"""WITH {EDGES}, o AS (SELECT e.src AS node, 'direct' AS reason, confidence FROM edges e JOIN supplier s ON e.dst = 'supplier:' || s.s_suppkey WHERE s_nationkey = 3),
t AS (SELECT e.src AS node, 'through part' AS reason, confidence * 0.5 AS confidence FROM edges e JOIN (SELECT DISTINCT node FROM o) m ON e.dst = m.node)
SELECT node, round(max(confidence), 4) AS confidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY node"""


QUERIES = {
    "graph_degrees": lambda s, d: G.degrees(edges(s, d)), "graph_hubs_bridges": lambda s, d: G.hubs_and_bridges(edges(s, d)), "graph_report": report, "graph_orphans": orphans,
    "graph_components": component_table, "graph_community_records": community_records, "graph_surprising": surprising, "graph_bfs_path": bfs_path, "graph_downstream3": downstream,
    "relation_query_page": relation_page, "relation_path_score": path_score, "impact_blast_radius": blast_radius,
}
ORACLES = {
    "graph_degrees": f"WITH {EDGES}, {DEGREES} SELECT * FROM deg",
    "graph_hubs_bridges": f"WITH {EDGES}, {DEGREES} SELECT * FROM (SELECT 'hub' AS role, node, degree AS score FROM deg ORDER BY degree DESC, node LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bridge', node, in_degree * out_degree AS s FROM deg WHERE in_degree > 0 AND out_degree > 0 ORDER BY s DESC, node LIMIT 10)",
    "graph_report": f"""WITH {EDGES}, t AS (SELECT kind, src, count(*) AS n FROM edges GROUP BY kind, src QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, src) = 1)
SELECT e.kind, count(*) AS n_edges, count(*) FILTER (provenance = 'extracted') AS n_extracted, count(*) FILTER (provenance = 'inferred') AS n_inferred, count(*) FILTER (provenance = 'ambiguous') AS n_ambiguous, round(avg(confidence), 4) AS mean_confidence, first(t.src) AS top_src, first(t.n) AS top_out FROM edges e JOIN t ON e.kind = t.kind GROUP BY e.kind""",
    "graph_orphans": "SELECT 'customer' AS kind, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)",
    "graph_components": _COMPONENTS, "graph_community_records": _RECORDS, "graph_surprising": _SURPRISING, "graph_bfs_path": _BFS, "graph_downstream3": _DOWN,
    "relation_query_page": _PAGE,
    "relation_path_score": f"WITH {EDGES}, e AS (SELECT *, CASE provenance WHEN 'extracted' THEN 1.0 WHEN 'derived' THEN 0.8 WHEN 'inferred' THEN 0.6 ELSE 0.4 END::DOUBLE AS w FROM edges WHERE kind IN ('located_in', 'part_of')) SELECT a.src, b.dst, round((a.w + b.w) / 2 / 2, 4) AS score FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'customer:%'",
    "impact_blast_radius": _BLAST,
}
