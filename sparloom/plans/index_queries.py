"""Stored indexes: full text, shards and the ladder, over the generated source files of ``part`` and all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import fulltext as T
from ..operators import repo as R
from ..operators import shards as H
from ..sources.tables import table
from ..storage import place_for, stored
from . import repo_queries as Q

ASKED, ASKED_PART, ASKED_SOURCE = "helper licensed version", "licens helpe", "gone helper f12"
LIMIT = 60


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat_ws("/", F.lit("corpus"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))
    both = Q.files(spark, d).unionByName(docs)
    return both.select("path", F.coalesce(P.language(F.col("path")), F.lit("text")).alias("language"), "content")


def _built(spark: SparkSession, d: str, full_text: bool = True) -> tuple[str, DataFrame]:
    f, place = stored(files(spark, d), "files"), place_for(spark, "fulltext")
    T.build(f, stored(R.symbols(f), "symbols"), place, full_text=full_text)
    return place, f


def fulltext(spark, d):
    return T.search(spark, _built(spark, d)[0], ASKED, limit=LIMIT)


def substring(spark, d):
    return T.search(spark, _built(spark, d, False)[0], ASKED_PART, lanes=["runtime", "docs"], limit=LIMIT, mode="like")


def frequencies(spark, d):
    """In how many files and symbols each token of the query stands, by the index's own counts."""
    place, _ = _built(spark, d)
    words = T.query_tokens(ASKED)
    buckets = int(T.metadata(spark, place)["buckets"])
    rows = T.V.opened(spark, place, "frequencies").where(F.col("bucket").isin([T.bucket_of(w, buckets) for w in words]) & F.col("token").isin(words))
    return rows.select("token", "part", "n")


def index_status(spark, d):
    """An index that there isn't, one that is right, and one of files that have changed since."""
    place, f = _built(spark, d)
    grown = f.withColumn("content", F.when(F.col("path").endswith("12.ts"), F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    cases = (("missing", place_for(spark, "none"), f), ("built", place, f), ("changed", place, grown))
    out = None
    for name, at, now in cases:
        row = T.status(spark, at, now).select(F.lit(name).alias("case"), "present", "status", "fresh", "file_count", "symbol_count", "byte_length", F.array_join("modes", ",").alias("modes"), F.array_join("reasons", ",").alias("reasons"))
        out = row if out is None else out.unionByName(row)
    return out


def _sources(spark: SparkSession, d: str, later: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source files before or after a change: one package edited, a folder gone, another one new."""
    f = Q.files(spark, d).withColumn("language", P.language(F.col("path")))
    if later:
        edited = F.col("path").startswith("packages/p1/") & F.col("path").endswith("2.ts")
        f = f.where("path NOT LIKE 'lib/%'").withColumn("content", F.when(edited, F.concat("content", F.lit("\n// edited"))).otherwise(F.col("content")))
    else:
        f = f.where("path NOT LIKE 'docs/%'")
    # all three are read many times
    f = stored(f, "sources")
    found = stored(R.symbols(f), "symbols")
    return f, found, stored(R.fact_graph(f, found)[1], "edges")


def _sharded(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    place = place_for(spark, "shards")
    H.refresh(*_sources(spark, d, False), place)
    return place, H.refresh(*_sources(spark, d, True), place)


def shard_refresh(spark, d):
    """The manifest after a refresh, with what the refresh did to each shard."""
    place, steps = _sharded(spark, d)
    return steps.join(H.manifest(spark, place), "shard", "left").select("shard", "step", "lane", "files", "symbols", "edges", "bytes")


def shard_search(spark, d):
    """A search over the refreshed shards of two lanes."""
    place, _ = _sharded(spark, d)
    return H.search(spark, place, ASKED_SOURCE, ["runtime", "docs"], LIMIT)


def ladder(spark, d):
    """The same question answered by each way in turn; refused while a fresh index is asked for and there is none."""
    f, found, edges = _sources(spark, d, True)
    index, shards, none = place_for(spark, "fulltext"), place_for(spark, "shards"), place_for(spark, "none")
    prepared = (stored(T.prepared(f, found), "prepared"), T.symbol_rows(found))
    ask = lambda *a, **k: stored(H.retrieve(spark, ASKED_SOURCE, *a, limit=20, **k), "answer")
    out = [ask(index, shards, prepared, require_fresh=True, now=f), ask(index, shards, prepared)]
    H.refresh(f, found, edges, shards)
    out.append(ask(index, shards, prepared))
    T.build(f, found, index, full_text=False)
    out.append(ask(index, shards, prepared))
    T.build(f, found, index)
    out += [ask(index, shards, prepared, require_fresh=True, now=f), ask(none, none)]
    counted = [x.groupBy("retrieval_mode").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("least")) for x in out]
    whole = counted[0]
    for x in counted[1:]:
        whole = whole.unionByName(x)
    return whole


_REPO = f"{Q._F}, {Q._SYM}"
_ALL = f"""docs AS (SELECT 'corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, 'text' AS language, coalesce(text, '') AS content FROM documents),
names AS (SELECT path, string_agg(name, ' ' ORDER BY line) AS names FROM sym GROUP BY path),
every AS (SELECT path, language, content, coalesce(names, '') AS symbols_text, CASE WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'docs/%' THEN 'docs' ELSE 'runtime' END AS lane
 FROM (SELECT path, {Q._LANG} AS language, content FROM files UNION ALL SELECT * FROM docs) LEFT JOIN names USING (path))"""
_HAY = "lower(path || ' ' || language || ' ' || symbols_text || ' ' || content)"
_NAMED = "lower(name || ' ' || kind || ' ' || path)"
_LANES = " AND (path NOT LIKE 'tests/%')"


def _score(hay: str, q: str, fixed: bool, phrase: bool = True) -> str:
    tokens = T.query_tokens(q)
    each = [f"CASE WHEN contains(lower({hay}), '{t}') THEN {5 if fixed else len(t)} ELSE 0 END" for t in tokens]
    return "(" + " + ".join(each + [f"CASE WHEN contains(lower({hay}), '{q}') THEN {20 if fixed else 2 * len(q)} ELSE 0 END"] * phrase) + ")"


def _ranked(q: str, limit: int, fixed: bool = False, every: str = "every", where: str = "true", where_symbol: str = "true") -> str:
    s = lambda hay, phrase=True: _score(hay, q, fixed, phrase)
    near = f"(2 * {s(chr(112) + 'ath || chr(32) || language')} + {s('symbols_text')})"
    own = f"({s('name || chr(32) || kind || chr(32) || path')} + 3 * {s('name', False)})"
    line = s("t")
    short = r"regexp_replace(t, '^\s+|\s+$', '', 'g')"
    return f"""SELECT * FROM (
 SELECT 'symbol' AS kind, path, line, {own} + 5 AS score, kind || ' ' || name AS title, kind || ' ' || name || ' in ' || path || ':' || line AS excerpt FROM sym WHERE {own} > 0 AND {where_symbol}
 UNION ALL SELECT 'file', path, 1, {near}, path, path FROM {every} WHERE {near} > 0 AND {where}
 UNION ALL SELECT 'file', path, i, {line} + {near}, path || ':' || i, CASE WHEN length({short}) > 160 THEN substr({short}, 1, 157) || '...' ELSE {short} END
  FROM (SELECT e.*, u.i, u.t FROM (SELECT *, str_split(content, chr(10)) AS parts FROM {every} WHERE {where}) e, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS t) u) WHERE {line} > 0)
 ORDER BY score DESC, path, line, kind DESC, title, excerpt LIMIT {limit}"""


def _whole(hay: str, q: str) -> str:
    return f"regexp_matches({hay}, '(^|[^\\pL\\pN])({'|'.join(T.query_tokens(q))})([^\\pL\\pN]|$)')"


def _some(hay: str, q: str) -> str:
    return "(" + " OR ".join(f"contains({hay}, '{t}')" for t in T.query_tokens(q)) + ")"


_STATUS = "SELECT 'missing' AS \"case\", false AS present, 'missing' AS status, false AS fresh, 0 AS file_count, 0 AS symbol_count, 0 AS byte_length, '' AS modes, 'MISSING' AS reasons"
_LATER = f"SELECT path, CASE WHEN path LIKE 'packages/p1/%2.ts' THEN content || chr(10) || '// edited' ELSE content END AS content FROM ({Q._FILES}) WHERE path NOT LIKE 'lib/%'"
_LATER_EDGES = Q._EDGES.replace(f"files AS ({Q._FILES})", f"files AS ({_LATER})")
_LATER_REPO = _REPO.replace(f"files AS ({Q._FILES})", f"files AS ({_LATER})")
_SHARD = "CASE WHEN {0} LIKE 'packages/%' OR {0} LIKE 'src/%' THEN str_split({0}, '/')[1] || '/' || str_split({0}, '/')[2] ELSE str_split({0}, '/')[1] END"
_LATER_ALL = _ALL.replace("UNION ALL SELECT * FROM docs", "").replace("docs AS (SELECT", "docs AS (SELECT NULL AS x, ")

QUERIES = {
    "search_fulltext": fulltext, "search_substring": substring, "index_frequencies": frequencies, "index_status": index_status,
    "index_shard_refresh": shard_refresh, "index_shard_search": shard_search, "index_retrieval_ladder": ladder,
}
ORACLES = {
    "search_fulltext": f"WITH {_REPO}, {_ALL} {_ranked(ASKED, LIMIT, where=_whole(_HAY, ASKED), where_symbol=_whole(_NAMED, ASKED))}",
    "search_substring": f"WITH {_REPO}, {_ALL} {_ranked(ASKED_PART, LIMIT, where=_some(_HAY, ASKED_PART) + _LANES, where_symbol=_some(_NAMED, ASKED_PART) + _LANES)}",
    "index_frequencies": f"WITH {_REPO}, {_ALL} SELECT token, part, count(*) AS n FROM (SELECT 'file' AS part, path AS key, unnest(list_distinct(regexp_extract_all({_HAY}, '[\\pL\\pN]+'))) AS token FROM every UNION ALL SELECT 'symbol', id, unnest(list_distinct(regexp_extract_all({_NAMED}, '[\\pL\\pN]+'))) FROM sym) WHERE token IN ('helper', 'licensed', 'version') GROUP BY ALL",
    "index_status": f"""WITH {_REPO}, {_ALL}, n AS (SELECT count(*) AS f, sum(octet_length(encode(content)))::BIGINT AS b FROM every), m AS (SELECT count(*) AS s FROM sym) {_STATUS}
 UNION ALL SELECT 'built', true, 'ok', true, f, s, b, 'fts,like', '' FROM n, m UNION ALL SELECT 'changed', true, 'stale', false, f, s, b, 'fts,like', 'FINGERPRINT' FROM n, m""",
    "index_shard_refresh": f"""{_LATER_EDGES}, sh AS (SELECT {_SHARD.format('path')} AS shard, path, octet_length(encode(content)) AS b FROM files),
sums AS (SELECT shard, count(*) AS files, sum(b)::BIGINT AS bytes, max(path LIKE 'packages/p1/%2.ts') AS hit FROM sh GROUP BY shard),
ss AS (SELECT {_SHARD.format('path')} AS shard, count(*) AS symbols FROM sym GROUP BY 1), es AS (SELECT {_SHARD.format("str_split(src, '#')[1]")} AS shard, count(*) AS edges FROM (SELECT DISTINCT * FROM edges) GROUP BY 1)
SELECT shard, CASE WHEN shard = 'docs' THEN 'added' WHEN hit THEN 'rewritten' ELSE 'kept' END AS step, CASE shard WHEN 'docs' THEN 'docs' WHEN 'tests' THEN 'tests' ELSE 'runtime' END AS lane, files, coalesce(symbols, 0) AS symbols, coalesce(edges, 0) AS edges, bytes
 FROM sums LEFT JOIN ss USING (shard) LEFT JOIN es USING (shard) UNION ALL SELECT 'lib', 'removed', NULL, NULL, NULL, NULL, NULL""",
    "index_shard_search": f"WITH {_LATER_REPO}, {_LATER_ALL} {_ranked(ASKED_SOURCE, LIMIT, True, where='true' + _LANES, where_symbol='true' + _LANES)}",
    "index_retrieval_ladder": f"""WITH {_LATER_REPO}, {_LATER_ALL}, a AS ({_ranked(ASKED_SOURCE, 20, True)}), b AS ({_ranked(ASKED_SOURCE, 20, where=_some(_HAY, ASKED_SOURCE), where_symbol=_some(_NAMED, ASKED_SOURCE))}),
c AS ({_ranked(ASKED_SOURCE, 20, where=_whole(_HAY, ASKED_SOURCE), where_symbol=_whole(_NAMED, ASKED_SOURCE))})
SELECT retrieval_mode, count(*) AS n, max(score) AS best, min(score) AS least FROM (SELECT 'full' AS retrieval_mode, * FROM a UNION ALL SELECT 'manifest', * FROM a UNION ALL SELECT 'like', * FROM b UNION ALL SELECT 'fts', * FROM c) GROUP BY 1""",
}
