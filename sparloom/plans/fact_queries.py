"""The store of fact graphs, and facts and records kept by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import facts as K
from ..operators import repo as R
from ..sources.tables import table
from ..storage import place_for, stored
from . import repo_queries as Q

CURSOR, LIMIT = 1000, 500


def _edited(f: DataFrame) -> DataFrame:
    """Every tenth file, or so, with a further function."""
    return f.withColumn("content", F.when(F.col("path").endswith("2.ts"), F.concat("content", F.lit("\nconst later = (a) => a;"))).otherwise(F.col("content")))


def _store(spark: SparkSession, d: str) -> str:
    """Two roots, of which the second is written twice, the second time with other facts."""
    f, nodes, edges = Q._graph(spark, d)
    place = place_for(spark, "store")
    some = lambda df, col, like: df.where(F.col(col).like(like))
    K.write(some(nodes, "node", "lib/%"), some(edges, "src", "lib/%"), place, "one", "f0")
    K.write(nodes, edges, place, "whole", "f1", {"maxFiles": 10, "preset": "all"})
    K.write(some(nodes, "node", "docs/%"), some(edges, "src", "docs/%"), place, "one", "f2")
    return place


def page(spark, d):
    """A page of the whole root's facts, nodes before edges, each in order."""
    rows, _ = K.page(spark, _store(spark, d), "whole", CURSOR, LIMIT)
    return rows


def roots(spark, d):
    """What the store says of its roots, and what lies in them."""
    place = _store(spark, d)
    held = K._read(spark, place, "rows", K._ROWS).groupBy("repo_root").agg(F.count_if(F.col("part") == "node").alias("held_nodes"), F.count_if(F.col("part") == "edge").alias("held_edges"))
    return K.roots(spark, place).join(held, "repo_root").select("repo_root", "fingerprint", "options", "nodes", "edges", "held_nodes", "held_edges")


def stale(spark, d):
    """Why stored facts are stale, case by case."""
    place = _store(spark, d)
    now = {"fingerprint": "f1", "extractor": K.EXTRACTOR, "options": {"preset": "all", "maxFiles": 10}, "fresh": True}
    cases = [("right", "whole", now), ("no_index", "whole", None), ("no_store", "two", now), ("changed", "whole", now | {"fingerprint": "f9", "fresh": False}), ("other", "whole", now | {"extractor": "0", "options": {}})]
    out = None
    for name, root, current in cases:
        row = K.status(spark, place, root, current).select(F.lit(name).alias("case"), "present", "fresh", "nodes", "edges", F.array_join("reasons", ",").alias("reasons"))
        out = row if out is None else out.unionByName(row)
    return out


def _twice(spark: SparkSession, d: str):
    """Symbols by content of the files, then of the files with a tenth of them edited."""
    place, f = place_for(spark, "contents"), stored(Q.files(spark, d).withColumn("language", P.language(F.col("path"))), "files")
    draw = lambda x: R.symbols(x).select("path", "kind", "name", "line")
    _, first = K.by_content(f, place, "symbols", draw)
    later = _edited(f)
    found, second = K.by_content(later, place, "symbols", draw)
    return later, found, first, second


def cached_symbols(spark, d):
    """The symbols of the edited files: those of contents seen before come from the first run."""
    return _twice(spark, d)[1].select(F.concat("path", F.lit("#"), "name", F.lit(":"), F.col("line").cast("string")).alias("id"), "path", "kind", "name", "line")


def cached_runs(spark, d):
    """How many contents each run drew, of how many files."""
    later, _, first, second = _twice(spark, d)
    n = later.agg(F.count("*").alias("files"))
    one = lambda name, df: df.agg(F.count("*").alias("drawn")).select(F.lit(name).alias("run"), "drawn")
    return one("first", first).unionByName(one("second", second)).join(n, F.lit(True))  # one row


def records(spark, d):
    """Texts kept by content, in two runs; of equal texts the first by id stays."""
    place = place_for(spark, "records")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("text").alias("content"), "doc_id", "lang")
    out = None
    for run, some in (("even", docs.where("doc_id % 2 = 0")), ("all", docs)):
        new = K.put(some, place, "doc_id").select(F.lit(run).alias("run"), "key", "doc_id", "byte_length")
        out = new if out is None else out.unionByName(new)
    return out


QUERIES = {"fact_store_page": page, "fact_store_roots": roots, "fact_store_status": stale, "cache_symbols": cached_symbols, "cache_runs": cached_runs, "cache_records": records}
_NODES = "nodes AS (SELECT path AS node, 'file' AS kind FROM files UNION ALL SELECT id, kind FROM sym)"
_SIZES = "n AS (SELECT (SELECT count(*) FROM nodes) AS a, (SELECT count(*) FROM edges) AS b)"
_EDITED = f"SELECT path, CASE WHEN path LIKE '%2.ts' THEN content || chr(10) || 'const later = (a) => a;' ELSE content END AS content FROM ({Q._FILES})"
ORACLES = {
    "fact_store_page": f"""{Q._EDGES}, {_NODES}, rows_ AS (SELECT 'node' AS part, node, NULL AS src, NULL AS dst, kind, NULL AS line, NULL::DOUBLE AS confidence, 0 AS e FROM nodes UNION ALL SELECT 'edge', NULL, src, dst, kind, line, confidence, 1 FROM edges)
SELECT * FROM (SELECT row_number() OVER (ORDER BY e, node, src, kind, dst, line) - 1 AS nth, part, node, src, dst, kind, line, confidence FROM rows_) WHERE nth >= {CURSOR} AND nth < {CURSOR + LIMIT}""",
    "fact_store_roots": f"""{Q._EDGES}, {_NODES}, {_SIZES} SELECT 'whole' AS repo_root, 'f1' AS fingerprint, '{{"maxFiles":10,"preset":"all"}}' AS options, a AS nodes, b AS edges, a AS held_nodes, b AS held_edges FROM n
UNION ALL SELECT 'one', 'f2', '{{}}', x, y, x, y FROM (SELECT count(*) AS x FROM nodes WHERE node LIKE 'docs/%'), (SELECT count(*) AS y FROM edges WHERE src LIKE 'docs/%')""",
    "fact_store_status": f"""{Q._EDGES}, {_NODES}, {_SIZES} SELECT c AS "case", c <> 'no_store' AS present, c = 'right' AS fresh, CASE WHEN c = 'no_store' THEN 0 ELSE a END AS nodes, CASE WHEN c = 'no_store' THEN 0 ELSE b END AS edges, r AS reasons FROM n,
(VALUES ('right', ''), ('no_index', 'current_index_missing'), ('no_store', 'store_missing'), ('changed', 'current_index_stale,fact_fingerprint_mismatch'), ('other', 'current_extractor_version_mismatch,fact_extractor_version_mismatch,build_options_mismatch')) v(c, r)""",
    "cache_symbols": f"WITH {Q._F}, {Q._SYM} SELECT id, path, kind, name, line FROM sym UNION ALL SELECT path || '#later:' || (len(str_split(content, chr(10))) + 1), path, 'function', 'later', len(str_split(content, chr(10))) + 1 FROM files WHERE path LIKE '%2.ts'",
    "cache_runs": f"WITH a AS (SELECT DISTINCT right(path, 3) AS e, content FROM ({Q._FILES})), b AS (SELECT DISTINCT right(path, 3) AS e, content FROM ({_EDITED})) SELECT 'first' AS run, (SELECT count(*) FROM a) AS drawn, (SELECT count(*) FROM ({Q._FILES})) AS files UNION ALL SELECT 'second', (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)), (SELECT count(*) FROM ({Q._FILES}))",
    "cache_records": "SELECT CASE WHEN min(doc_id % 2) = 0 THEN 'even' ELSE 'all' END AS run, 'sha256:' || sha256(text) AS key, CASE WHEN min(doc_id % 2) = 0 THEN min(doc_id) FILTER (doc_id % 2 = 0) ELSE min(doc_id) END AS doc_id, octet_length(encode(text)) AS byte_length FROM documents WHERE text IS NOT NULL GROUP BY text",
}
