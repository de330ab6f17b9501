"""Context packs over ``documents``, sources of a context and search of nodes over the source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import nodes as N
from ..operators import packs as K
from ..operators import relations as L
from ..operators import repo as R
from ..operators.reviews import AUTHORITY_SCORE
from ..operators.search import query_tokens
from ..sources.tables import table
from ..storage import place_for
from . import corpus_queries as C
from . import relation_queries as T
from . import repo_queries as Q

ASKED, BUDGET = "the license of works", 30_000
NODES, SOURCES = "helper importing f12 core", "helper m12 gone"


def pack(spark, d):
    """Documents that a budget keeps: some are pinned, some stale, some changed, the others by the query."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".ts"))).alias("source"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 10).alias("recorded"))
    some = lambda k: rows.where(F.col("id") % k == 0)
    return K.budget_review(rows, ASKED, BUDGET, some(97), some(13), some(31))


def sources(spark, d):
    """The sources of a context for three changed files."""
    f, edges = T._facts(spark, d)
    changed = f.where("path IN ('packages/p0/src/m112.ts', 'src/core/m12.ts', 'gone.ts')").select("path")
    reached = L.routes(edges.where(F.col("kind").isin(*L.CARRY)), changed.select(F.col("path").alias("node")), T.DEPTH, "inbound", by_start=False)
    at = reached.select(R.file_of(F.col("node")).alias("node")).where("node IS NOT NULL").distinct()
    reached = at.select(F.when(P.is_test(F.col("node")), "test").otherwise("file").alias("kind"), "node")
    preferred = f.where("path LIKE 'docs/g4%7.md'").select("path")
    return K.select_sources(f, edges, changed, preferred, reached, SOURCES, 40)


def node_search(spark, d):
    """The nodes that stand nearest to a question, and what a changed and a missing index answer."""
    f, _, edges = Q._graph(spark, d)
    f = f.withColumn("language", P.language(F.col("path")))
    # the files of a module are its community
    modules = f.select(F.col("path").alias("node"), P.module_root(F.col("path")).alias("community"))
    place = place_for(spark, "nodes")
    N.build(f, R.symbols(f), edges.where("NOT startswith(dst, 'external:')"), modules, place)
    state, rows = N.search(f, place, NODES, limit=200)
    return rows.withColumn("state", F.lit(state))


QUERIES = {"context_pack_budget": pack, "context_sources": sources, "search_graph_nodes": node_search}
_AUTHORITY = f"CASE WHEN path LIKE '%.md' THEN {AUTHORITY_SCORE['supporting_doc']} WHEN path LIKE 'tests/%' THEN {AUTHORITY_SCORE['current_test']} ELSE {AUTHORITY_SCORE['current_code']} END"
_HITS = lambda hay, q, n=1: " + ".join(f"CASE WHEN contains(lower({hay}), '{t}') THEN {n} ELSE 0 END" for t in query_tokens(q))
_CHANGED = "path IN ('packages/p0/src/m112.ts', 'src/core/m12.ts', 'gone.ts')"
_STEMS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1))"
ORACLES = {
    "context_pack_budget": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.ts' END AS path, coalesce(text, '') AS text, doc_id % 10 AS recorded FROM documents),
x AS (SELECT id, path AS source, {_HITS("path || ' ' || text", ASKED)} AS score, {_AUTHORITY} AS own, id % 97 = 0 AS p, id % 13 = 0 AS s, id % 31 = 0 AS c, length(text) AS chars, recorded FROM d),
y AS (SELECT id, source, CASE WHEN s THEN 'stale' WHEN p THEN 'pinned' WHEN c THEN 'changed_file' ELSE 'query_match' END AS reason, (CASE WHEN p THEN 1000 ELSE 0 END + CASE WHEN c THEN 100 ELSE 0 END + score * 10 + own - CASE WHEN s THEN 10000 ELSE 0 END)::DOUBLE AS priority, chars, recorded FROM x WHERE score > 0 OR p OR s OR c),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY priority DESC, recorded DESC, source, id) AS rn FROM y WHERE reason <> 'stale'),
f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, false AS kept UNION ALL SELECT o.rn, CASE WHEN o.rn = 1 OR used + chars <= {BUDGET} THEN used + chars ELSE used END, o.rn = 1 OR used + chars <= {BUDGET} FROM f JOIN o ON o.rn = f.rn + 1)
SELECT id, source, CASE WHEN kept THEN reason ELSE 'budget' END AS reason, priority, chars, kept FROM o JOIN f USING (rn) UNION ALL SELECT id, source, reason, priority, chars, false FROM y WHERE reason = 'stale'""",
    "context_sources": f"""{T._REC}, {T._walk(f"SELECT path AS node FROM files WHERE {_CHANGED}", T._CARRY, False, True)}, at_ AS (SELECT DISTINCT str_split(node, '#')[1] AS path FROM reach),
scored AS (SELECT path, {_HITS("path", SOURCES, 2)} + {_HITS("content", SOURCES)} AS score, {_AUTHORITY} AS own FROM files),
every AS (SELECT 0 AS nth, 0.0::DOUBLE AS rank, 0.0::DOUBLE AS own, path, 'changed' AS reason FROM files WHERE {_CHANGED}
 UNION ALL SELECT 1, 0, 0, str_split(dst, '#')[1], 'neighbour' FROM edges WHERE kind IN ('imports', 'calls', 'references') AND dst NOT LIKE 'external:%' AND str_split(src, '#')[1] IN (SELECT path FROM files WHERE {_CHANGED}) AND str_split(src, '#')[1] <> str_split(dst, '#')[1]
 UNION ALL SELECT 2, 0, 0, path, 'preferred' FROM files WHERE path LIKE 'docs/g4%7.md' UNION ALL SELECT CASE WHEN path LIKE 'tests/%' THEN 4 ELSE 3 END, 0, 0, path, CASE WHEN path LIKE 'tests/%' THEN 'test' ELSE 'impacted' END FROM at_
 UNION ALL SELECT 5, -score, -own, path, 'query' FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, own DESC, path LIMIT 6)),
once AS (SELECT * FROM every WHERE path IN (SELECT path FROM files) QUALIFY row_number() OVER (PARTITION BY path ORDER BY nth, rank, own, reason) = 1)
SELECT row_number() OVER (ORDER BY nth, rank, own, path)::INT AS place, path, reason FROM (SELECT * FROM once ORDER BY nth, rank, own, path LIMIT 40)""",
    "search_graph_nodes": f"""{Q._EDGES}, cm AS (SELECT path AS node, {T._MODULE} AS community FROM files),
mem AS (SELECT DISTINCT str_split(node, '#')[1] AS path, community FROM cm), near AS (SELECT * FROM edges WHERE kind IN ('calls', 'references')),
rec AS (SELECT 'graph:file:' || path AS id, 'file' AS kind, 'file ' || path || ' language ' || {Q._LANG} || ' ' || substr(content, 1, 2000) AS text FROM files UNION ALL SELECT 'graph:file:' || path, 'file', 'symbols ' || name FROM sym UNION ALL SELECT 'graph:file:' || path, 'file', 'communities ' || community FROM mem
 UNION ALL SELECT 'graph:symbol:' || id, 'symbol', 'symbol ' || name || ' kind ' || kind || ' file ' || path || ' line ' || line FROM sym UNION ALL SELECT 'graph:symbol:' || src, 'symbol', 'uses ' || regexp_extract(dst, '#([^:]*)', 1) FROM near WHERE contains(src, '#')
 UNION ALL SELECT 'graph:symbol:' || dst, 'symbol', 'used by ' || regexp_extract(src, '#?([^#:]*)(:|$)', 1) FROM near WHERE contains(dst, '#') UNION ALL SELECT 'graph:community:' || community, 'community', 'community ' || community || ' members ' || node FROM cm),
tok AS (SELECT DISTINCT id, kind, {C._STEM} AS t FROM (SELECT id, kind, unnest({_STEMS('text')}) AS x FROM rec)), ask AS (SELECT DISTINCT {C._STEM} AS t FROM (SELECT unnest({_STEMS(f"'{NODES}'")}) AS x))
SELECT id, kind, round(count(*) / (SELECT count(*) FROM ask)::DOUBLE, 4) AS score, 'ok' AS state FROM tok WHERE t IN (SELECT t FROM ask) GROUP BY id, kind ORDER BY score DESC, id LIMIT 200""",
}
