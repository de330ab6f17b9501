"""Page, endpoint, domain, check and planning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import discovery as D
from ..sources.tables import table



def gaps(spark, d):
    T = lambda n: table(spark, d, n)
    return D.coverage_gaps({"customer": (T("customer"), "c_custkey"), "nation": (T("nation"), "n_nationkey"), "part": (T("part"), "p_partkey")}, {"customer": (T("orders"), "o_custkey"), "nation": (T("supplier"), "s_nationkey"), "part": (T("lineitem"), "l_partkey")})


def endpoint_groups(spark, d):
    return D.endpoint_groups(table(spark, d, "pages").select("url"))


_ENDPOINTS = r"""WITH x AS (SELECT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin,
 array_to_string(list_transform(str_split(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') OR (length(s) >= 18 AND regexp_matches(s, '^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$')) THEN '{id}' ELSE s END), '/') AS path_template,
 list_filter(list_transform(str_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: str_split(p, '=')[1]), lambda k: k <> '') AS keys FROM pages),
k AS (SELECT origin, path_template, string_agg(DISTINCT key, ',' ORDER BY key) AS query_keys FROM (SELECT origin, path_template, unnest(keys) AS key FROM x) GROUP BY origin, path_template)
SELECT x.origin, x.path_template, count(*) AS n, coalesce(first(query_keys), '') AS query_keys FROM x LEFT JOIN k ON x.origin = k.origin AND x.path_template = k.path_template GROUP BY x.origin, x.path_template"""


def ownership(spark, d):
    """Each page's owner: the longest site name of a fixed list that its host holds."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1))
    owners = spark.createDataFrame([("example.com", "com"), ("example.net", "net"), ("example.org", "org"), ("blog.", "blog")], "part string, owner string")
    hit = table(spark, d, "pages").select("page_id", host.alias("host")).join(F.broadcast(owners), F.col("host").contains(F.col("part")), "left")
    return hit.groupBy("page_id").agg(F.max_by("owner", F.struct(F.length("part"), "owner")).alias("owner"))


def flags(spark, d):
    """Side effects that pages hint at."""
    h = F.lower("html")
    return table(spark, d, "pages").select("page_id", h.contains("<form").alias("has_form"), h.contains("<script").alias("has_script"), F.regexp_count(h, F.lit("<li>")).cast("long").alias("n_items"), h.contains("class=\"ad\"").alias("has_ad"))


def modules(spark, d):
    """Sources as modules: files, languages, and the modules that share a line with them."""
    docs = table(spark, d, "documents")
    x = docs.select("source", F.explode(F.split("text", "\n", -1)).alias("l")).select("source", F.trim("l").alias("l")).where("length(l) >= 20").distinct()
    pairs = x.join(x.select("l", F.col("source").alias("other")), "l").where("source <> other").groupBy("source").agg(F.countDistinct("other").alias("n_neighbours"))
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars")).join(pairs, "source", "left").select("source", "files", "languages", "chars", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def globs(spark, d):
    """Paths that a glob and a prefix take."""
    f = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return f.select("doc_id", F.col("path").rlike(P.glob_regex("src?/**/*1.txt")).alias("by_glob"), P.is_under(F.col("path"), F.lit("src1/en")).alias("by_prefix")).where("by_glob OR by_prefix")


def severity(spark, d):
    """Findings by severity, zero where there is none, and the highest."""
    e = table(spark, d, "events").withColumn("severity", F.when((F.col("event_type") == "error") & (F.col("value") > 100), "high").when(F.col("event_type") == "error", "medium").when(F.col("value") > 200, "low"))
    return e.groupBy("user_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")]).withColumn("highest", F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").when(F.col("low") > 0, "low").otherwise("none"))


def dominant(spark, d):
    """The commonest event type of each user; ties by name."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k = 1").select("user_id", F.col("event_type").alias("dominant"), "n")


def greedy_match(spark, d):
    """Each user's purchases paired with views in order, one to one."""
    e = table(spark, d, "events")
    nth = lambda t: e.where(F.col("event_type") == t).select("user_id", F.col("event_id").alias(t), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nth"))
    return nth("purchase").join(nth("view"), ["user_id", "nth"], "left").select("user_id", F.col("nth").cast("long").alias("nth"), "purchase", "view")


QUERIES = {
    "domain_coverage_gaps": gaps, "api_endpoint_groups": endpoint_groups, "page_links": lambda s, d: D.page_links(table(s, d, "pages")), "domain_endpoint_ownership": ownership,
    "domain_side_effects": flags, "architecture_modules": modules,
    "filter_globs": globs, "check_severity": severity, "agg_dominant": dominant, "match_greedy": greedy_match,
}
ORACLES = {
    "domain_coverage_gaps": "SELECT 'customer without link' AS gap, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'nation without link', n_nationkey::BIGINT FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'part without link', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "api_endpoint_groups": _ENDPOINTS,
    "page_links": "SELECT page_id, u.ord, u.href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS h FROM pages) p, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS ord, unnest(h) AS href) u",
    "domain_endpoint_ownership": "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages), o(part, owner) AS (VALUES ('example.com', 'com'), ('example.net', 'net'), ('example.org', 'org'), ('blog.', 'blog')) SELECT page_id, first(owner ORDER BY length(part) DESC, owner DESC) AS owner FROM h LEFT JOIN o ON contains(host, part) GROUP BY page_id",
    "domain_side_effects": "SELECT page_id, contains(lower(html), '<form') AS has_form, contains(lower(html), '<script') AS has_script, CAST(len(regexp_extract_all(lower(html), '<li>')) AS BIGINT) AS n_items, contains(lower(html), 'class=\"ad\"') AS has_ad FROM pages",
    "architecture_modules": "WITH x AS (SELECT DISTINCT source, trim(l) AS l FROM (SELECT source, unnest(str_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 20), p AS (SELECT a.source, count(DISTINCT b.source) AS n FROM x a JOIN x b ON a.l = b.l WHERE a.source <> b.source GROUP BY a.source) SELECT d.source, count(*) AS files, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars, coalesce(first(p.n), 0) AS n_neighbours FROM documents d LEFT JOIN p ON d.source = p.source GROUP BY d.source",
    "filter_globs": "WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents) SELECT doc_id, regexp_matches(path, '^src[^/]/.*/[^/]*1\\.txt$') AS by_glob, path = 'src1/en' OR starts_with(path, 'src1/en/') AS by_prefix FROM f WHERE regexp_matches(path, '^src[^/]/.*/[^/]*1\\.txt$') OR starts_with(path, 'src1/en/')",
    "check_severity": "WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'high' WHEN event_type = 'error' THEN 'medium' WHEN value > 200 THEN 'low' END AS s FROM events), g AS (SELECT user_id, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low FROM e GROUP BY user_id) SELECT *, CASE WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'none' END AS highest FROM g",
    "agg_dominant": "SELECT user_id, event_type AS dominant, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1",
    "match_greedy": "WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('purchase', 'view')) SELECT p.user_id, p.nth, p.event_id AS purchase, v.event_id AS view FROM n p LEFT JOIN n v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.nth = p.nth WHERE p.event_type = 'purchase'",
}
