"""Search and text queries, bound to ``documents`` as files of source/language/id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import search as S
from ..sources.tables import table

QUESTION = "the license version"
MEANING = "licensed works under the licenses"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "text")


FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, lang AS language, text FROM documents)"
LINES = "lines AS (SELECT doc_id, path, language, u.i AS line, u.t AS line_text FROM (SELECT *, str_split(text, chr(10)) AS parts FROM files) f, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS t) u)"


def _score(hay: str, whole: int, each: list[tuple[str, int]], phrase: str) -> str:
    return "(" + " + ".join([f"CASE WHEN contains(lower({hay}), '{phrase}') THEN {whole} ELSE 0 END"] + [f"CASE WHEN contains(lower({hay}), '{t}') THEN {w} ELSE 0 END" for t, w in each]) + ")"


def _excerpt(c: str) -> str:
    x = f"trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'))"
    return f"CASE WHEN length({x}) > 160 THEN substr({x}, 1, 157) || '...' ELSE {x} END"


def _lexical_sql(weighting: str) -> str:
    tokens = S.query_tokens(QUESTION)
    whole, each = (20, [(t, 5) for t in tokens]) if weighting == "fixed" else (2 * len(QUESTION), [(t, len(t)) for t in tokens])
    s = lambda h: _score(h, whole, each, QUESTION)
    return f"""WITH {FILES}, {LINES}
SELECT kind, path, line, title, score FROM (
  SELECT 'line' AS kind, path, line, {_excerpt('line_text')} AS title, CAST({s('line_text')} + {s('path')} AS BIGINT) AS score FROM lines WHERE {s('line_text')} > 0
  UNION ALL
  SELECT 'file', path, 0, path, CAST(2 * {s("path || ' ' || language")} AS BIGINT) FROM files WHERE {s("path || ' ' || language")} > 0
) ORDER BY score DESC, path, line, kind LIMIT 20"""


_STEM = "CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN substr(x, 1, length(x) - 3) || 'y' WHEN x LIKE '%ing' AND length(x) > 5 THEN substr(x, 1, length(x) - 3) WHEN x LIKE '%s' AND length(x) > 3 THEN substr(x, 1, length(x) - 1) ELSE x END"
STEMS = f"stems AS (SELECT DISTINCT doc_id, {_STEM} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS x FROM documents) WHERE length(x) > 1)"


def lexical_topk(spark, d):
    return S.lexical(files(spark, d), QUESTION)


def lexical_length(spark, d):
    return S.lexical(files(spark, d), QUESTION, weighting="length")


def semantic_overlap(spark, d):
    return S.semantic(table(spark, d, "documents"), "doc_id", "text", MEANING)


def semantic_index(spark, d):
    return S.semantic_index(table(spark, d, "documents"), "doc_id", "text")


_WANT = sorted({"licensed", "work", "under", "the", "license"})
_SEMANTIC = f"""WITH {STEMS}, hits AS (SELECT doc_id, count(*) AS n FROM stems WHERE t IN ({', '.join(f"'{t}'" for t in _WANT)}) GROUP BY doc_id)
SELECT * FROM (SELECT d.doc_id, round(coalesce(n, 0) / CAST({len(_WANT)} AS DOUBLE) + CASE WHEN contains(lower(text), '{MEANING}') THEN 2.0 ELSE 0.0 END, 4) AS score FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""


def hybrid_fusion(spark, d):
    f = files(spark, d)
    lex = f.select(F.col("doc_id").alias("key"), F.col("path").alias("title"), X.phrase_score(F.col("text"), QUESTION, S.query_tokens(QUESTION), 20, [5] * 3).alias("score")).where("score > 0")
    sem = S.semantic(f, "doc_id", "text", MEANING, 100).select(F.col("doc_id").alias("key"), F.lit(None).cast("string").alias("title"), "score")
    return S.hybrid(lex, sem, F.coalesce(F.col("title"), F.lit("")).contains("src0/"))


_HYBRID = f"""WITH {FILES}, {STEMS}, hits AS (SELECT doc_id, count(*) AS n FROM stems WHERE t IN ({', '.join(f"'{t}'" for t in _WANT)}) GROUP BY doc_id),
a AS (SELECT doc_id, path, s / greatest(s, 20.0) AS a FROM (SELECT doc_id, path, CAST({_score('text', 20, [(t, 5) for t in S.query_tokens(QUESTION)], QUESTION)} AS DOUBLE) AS s FROM files) WHERE s > 0),
b AS (SELECT doc_id, s / greatest(s, 20.0) AS b FROM (SELECT d.doc_id, round(coalesce(n, 0) / CAST({len(_WANT)} AS DOUBLE) + CASE WHEN contains(lower(text), '{MEANING}') THEN 2.0 ELSE 0.0 END, 4) AS s FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 100),
m AS (SELECT coalesce(a.doc_id, b.doc_id) AS key, a.a, b.b, CASE WHEN contains(coalesce(path, ''), 'src0/') THEN 0.3 ELSE 0.0 END AS e FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)
SELECT key, round(CASE WHEN b IS NULL THEN a + e ELSE greatest(coalesce(a + e, 0.0), b) + e END + e + CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.15 ELSE 0.0 END, 4) AS score,
  CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS BIGINT) AS n_sources FROM m ORDER BY score DESC, key LIMIT 20"""


def context_rank(spark, d):
    """Context records by token hits, then authority, then source."""
    docs = table(spark, d, "documents")
    hits = X.phrase_score(F.col("text"), "", S.query_tokens(QUESTION), 0, [1] * 3)
    authority = F.when(F.col("lang") == "en", 90).when(F.col("lang") == "de", 70).otherwise(50)
    return docs.select("doc_id", "source", hits.cast("long").alias("hits"), authority.cast("long").alias("authority")).where("hits > 0").orderBy(F.desc("hits"), F.desc("authority"), "source", "doc_id").limit(25)


_CONTEXT = f"""SELECT * FROM (SELECT doc_id, source, CAST({_score('text', 0, [(t, 1) for t in S.query_tokens(QUESTION)], QUESTION)} AS BIGINT) AS hits, CAST(CASE lang WHEN 'en' THEN 90 WHEN 'de' THEN 70 ELSE 50 END AS BIGINT) AS authority FROM documents) WHERE hits > 0 ORDER BY hits DESC, authority DESC, source, doc_id LIMIT 25"""


def ir_metrics(spark, d):
    """Longest documents first, judged by the documents of good quality."""
    ranked = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select(F.col("doc_id").alias("key"), "rank")
    return S.retrieval_metrics(ranked, table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key")).distinct())


_IR = """WITH r AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
e AS (SELECT DISTINCT doc_id AS key FROM labels WHERE quality = 1),
m AS (SELECT count(*) AS n_expected, count(rank) AS n_hit, round(avg(coalesce(1.0 / rank, 0.0)), 4) AS mrr FROM e LEFT JOIN r ON e.key = r.key)
SELECT (SELECT count(*) FROM r) AS n_ranked, n_expected, n_hit, round(n_hit / CAST((SELECT count(*) FROM r) AS DOUBLE), 4) AS precision, round(n_hit / CAST(n_expected AS DOUBLE), 4) AS recall, mrr FROM m"""


def tokens_df(spark, d):
    """Document counts of identifiers, the 50 commonest."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(X.identifier_tokens(F.col("text"))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "token").limit(50)


_TOKENS = """WITH t AS (SELECT DISTINCT doc_id, x AS token FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_$]+')) AS x FROM documents) WHERE length(x) >= 3 AND regexp_matches(x, '^[A-Za-z_$]'))
SELECT token, count(*) AS n_docs FROM t GROUP BY token ORDER BY n_docs DESC, token LIMIT 50"""


def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


def dense_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", X.dense_summary(F.col("text")).alias("summary"))


_SENT = "trim(regexp_replace(s, '[ \\t\\r\\n]+', ' ', 'g'))"
_DENSE = f"""WITH s AS (SELECT doc_id, list_slice(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: {_SENT}), lambda s: s <> ''), 1, 5) AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda s: '- ' || CASE WHEN length(s) > 120 THEN substr(s, 1, 117) || '...' ELSE s END), chr(10)) AS summary FROM s"""


def complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", X.complexity(F.col("text")).alias("complexity"))


def token_budget(spark, d):
    """Estimated tokens by source: before, kept within 400 a document, and saved."""
    est = X.token_estimate(F.col("text"))
    return table(spark, d, "documents").select("source", est.alias("n"), F.least(est, F.lit(400)).alias("kept")).groupBy("source").agg(F.count("*").alias("runs"), F.sum("n").alias("before_tokens"), F.sum("kept").alias("after_tokens"), F.sum(F.greatest(F.lit(0), F.col("n") - F.col("kept"))).alias("saved_tokens"))


def compaction(spark, d):
    """Lines that stay when a long output is shortened: the first three, the last three and those with a
    diagnostic word, with the lines left out before each."""
    x = X.lines(table(spark, d, "documents").select("doc_id", "text")).drop("text")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    kept = x.withColumn("n", n).where((F.col("line") <= 3) | (F.col("line") > F.col("n") - 3) | F.lower("line_text").rlike("error|warn|fail|license"))
    w = Window.partitionBy("doc_id").orderBy("line")
    return kept.select("doc_id", "line", (F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(0)) - 1).cast("long").alias("omitted_before"), X.excerpt(F.col("line_text")).alias("line_text"))


_COMPACTION = f"""WITH {FILES}, {LINES}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
SELECT doc_id, line, CAST(line - coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line), 0) - 1 AS BIGINT) AS omitted_before, {_excerpt('line_text')} AS line_text FROM k
WHERE line <= 3 OR line > n - 3 OR regexp_matches(lower(line_text), 'error|warn|fail|license')"""

_SECRET = r"(?i)(secret|token|password|api[_-]?key)[ ]*[:=][ ]*[\"']?([A-Za-z0-9_./+=-]{16,})"


def secret_scan(spark, d):
    """Credentials by line, shortened to their ends."""
    x = X.lines(table(spark, d, "documents").select("doc_id", "text"))
    v = F.regexp_extract("line_text", _SECRET, 2)
    return x.where(F.col("line_text").rlike(_SECRET)).select("doc_id", "line", F.concat(F.substring(v, 1, 3), F.lit("..."), F.substring(v, F.length(v) - 3, F.lit(4))).alias("redacted"), F.lit("high").alias("severity")).distinct()


_SECRET_SQL = f"""WITH {FILES}, {LINES}, v AS (SELECT doc_id, line, regexp_extract(line_text, '{_SECRET.replace("'", "''").replace(chr(92) + chr(34), chr(34))}', 2) AS v FROM lines)
SELECT DISTINCT doc_id, line, substr(v, 1, 3) || '...' || substr(v, length(v) - 3, 4) AS redacted, 'high' AS severity FROM v WHERE v <> ''"""


def duplicate_blocks(spark, d):
    """Runs of three non-trivial lines that several documents have: the hash, and how many."""
    x = X.lines(table(spark, d, "documents").select("doc_id", "text")).withColumn("norm", X.one_line(F.lower("line_text"))).where("length(norm) > 3")
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(0, 2)
    blocks = x.select("doc_id", "line", F.collect_list("norm").over(w).alias("block")).where("size(block) = 3")
    return blocks.groupBy(F.sha2(F.array_join("block", "\n"), 256).alias("block_sha256")).agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


_BLOCKS = f"""WITH {FILES}, {LINES}, x AS (SELECT doc_id, line, trim(regexp_replace(lower(line_text), '[ \\t\\r\\n]+', ' ', 'g')) AS norm FROM lines),
b AS (SELECT doc_id, norm, lead(norm, 1) OVER w AS n1, lead(norm, 2) OVER w AS n2 FROM x WHERE length(norm) > 3 WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT sha256(norm || chr(10) || n1 || chr(10) || n2) AS block_sha256, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM b WHERE n2 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"""


def summary(spark, d):
    f = files(spark, d)
    return f.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))).cast("long").alias("lines"), F.slice(F.array_sort(F.collect_set(P.shard_root(F.col("path")))), 1, 3)[0].alias("first_root"))


def lanes(spark, d):
    """Files by lane, lanes without any included."""
    f = table(spark, d, "documents").select(P.lane(F.concat_ws("/", F.when(F.col("lang") == "de", "tests").when(F.col("lang") == "fr", "docs").otherwise("src"), F.col("doc_id").cast("string"))).alias("lane"))
    names = spark.createDataFrame([(x,) for x in ("runtime", "tests", "docs", "generated", "benchmarks", "fixtures")], "lane string")
    return names.join(f.groupBy("lane").agg(F.count("*").alias("n")), "lane", "left").select("lane", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def reference_edges(spark, d):
    """Which benchmark items' first words documents name, with words of too many items left out and the first
    five of a document kept."""
    symbols = table(spark, d, "benchmark").select("item_id", F.element_at(X.identifier_tokens(F.col("text")), 1).alias("name"))
    symbols = symbols.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n <= 25").select("item_id", "name")
    tokens = table(spark, d, "documents").select("doc_id", F.posexplode(X.identifier_tokens(F.col("text"))).alias("pos", "name"))
    hit = tokens.join(symbols, "name")
    return hit.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "item_id"))).where("nth <= 5").select("doc_id", "item_id", "name", F.col("nth").cast("long").alias("nth"))


_REFERENCES = r"""WITH s0 AS (SELECT item_id, (list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_$]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[A-Za-z_$]')))[1] AS name FROM benchmark),
s AS (SELECT item_id, name FROM s0 QUALIFY count(*) OVER (PARTITION BY name) <= 25),
t0 AS (SELECT doc_id, u.x AS name, u.pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_$]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[A-Za-z_$]')) AS p FROM documents) f, LATERAL (SELECT unnest(p) AS x, unnest(range(len(p))) AS pos) u),
t AS (SELECT doc_id, name, min(pos) AS pos FROM t0 GROUP BY doc_id, name)
SELECT doc_id, item_id, t.name, row_number() OVER (PARTITION BY doc_id ORDER BY pos, item_id) AS nth FROM t JOIN s ON t.name = s.name QUALIFY nth <= 5"""


def budget_fill(spark, d):
    """Documents taken in order of length while they fit a budget; those that don't are skipped, the first is always taken."""
    docs = table(spark, d, "documents")
    packed = docs.select("lang", "doc_id", "n_chars").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.negate("n_chars").alias("o"), "doc_id", "n_chars"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
    fill = F.aggregate("rows", start, lambda s, r: F.when((s["n"] == 0) | (s["used"] + r["n_chars"] <= 50000), F.struct((s["used"] + r["n_chars"]).alias("used"), (s["n"] + 1).alias("n"))).otherwise(s))
    return packed.select("lang", fill.alias("f")).select("lang", F.col("f.used").alias("used_chars"), F.col("f.n").alias("n_taken"))


_BUDGET = """WITH RECURSIVE r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
f AS (SELECT lang, k, n_chars AS used, CAST(1 AS BIGINT) AS n FROM r WHERE k = 1
  UNION ALL SELECT f.lang, r.k, CASE WHEN f.used + r.n_chars <= 50000 THEN f.used + r.n_chars ELSE f.used END, CASE WHEN f.used + r.n_chars <= 50000 THEN f.n + 1 ELSE f.n END FROM f JOIN r ON f.lang = r.lang AND r.k = f.k + 1)
SELECT lang, used AS used_chars, n AS n_taken FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC) = 1"""

QUERIES = {
    "search_lexical_topk": lexical_topk, "search_lexical_sqlite_weights": lexical_length, "search_semantic_overlap": semantic_overlap,
    "search_semantic_index": semantic_index, "search_hybrid_fusion": hybrid_fusion, "search_context_rank": context_rank, "search_ir_metrics": ir_metrics,
    "text_tokens_df": tokens_df, "text_excerpt": excerpts, "text_compaction": compaction, "text_dense_summary": dense_summary, "text_secret_scan": secret_scan,
    "text_duplicate_blocks": duplicate_blocks, "text_complexity": complexity, "text_token_budget": token_budget,
    "corpus_summary": summary, "corpus_lanes": lanes, "corpus_reference_edges": reference_edges, "corpus_budget_fill": budget_fill,
}
ORACLES = {
    "search_lexical_topk": _lexical_sql("fixed"), "search_lexical_sqlite_weights": _lexical_sql("length"), "search_semantic_overlap": _SEMANTIC,
    "search_semantic_index": f"WITH {STEMS} SELECT d.doc_id, coalesce(n, 0) AS n_tokens, sha256(coalesce(s, '')) AS tokens_sha256 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY t) AS s FROM stems GROUP BY doc_id) x ON d.doc_id = x.doc_id",
    "search_hybrid_fusion": _HYBRID, "search_context_rank": _CONTEXT, "search_ir_metrics": _IR, "text_tokens_df": _TOKENS,
    "text_excerpt": f"SELECT doc_id, {_excerpt('text')} AS excerpt FROM documents", "text_compaction": _COMPACTION, "text_dense_summary": _DENSE,
    "text_secret_scan": _SECRET_SQL, "text_duplicate_blocks": _BLOCKS,
    "text_complexity": "SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\\b(?:if|for|while|case|catch)\\b|&&|[|][|]|[?]')) AS BIGINT) AS complexity FROM documents",
    "text_token_budget": "WITH e AS (SELECT source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM documents) SELECT source, count(*) AS runs, CAST(sum(n) AS BIGINT) AS before_tokens, CAST(sum(least(n, 400)) AS BIGINT) AS after_tokens, CAST(sum(greatest(0, n - least(n, 400))) AS BIGINT) AS saved_tokens FROM e GROUP BY source",
    "corpus_summary": "SELECT lang AS language, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN text = '' THEN 0 ELSE len(str_split(text, chr(10))) END) AS BIGINT) AS lines, min(source) AS first_root FROM documents GROUP BY lang",
    "corpus_lanes": "WITH l AS (SELECT CASE lang WHEN 'de' THEN 'tests' WHEN 'fr' THEN 'docs' ELSE 'runtime' END AS lane FROM documents) SELECT n.lane, count(l.lane) AS files FROM (VALUES ('runtime'), ('tests'), ('docs'), ('generated'), ('benchmarks'), ('fixtures')) n(lane) LEFT JOIN l ON n.lane = l.lane GROUP BY n.lane",
    "corpus_reference_edges": _REFERENCES, "corpus_budget_fill": _BUDGET,
}
