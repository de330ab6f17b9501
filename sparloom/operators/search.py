"""Search and ranking over a corpus of (path, language, text) files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def query_tokens(q: str) -> list[str]:
    """Index tokens of a query, duplicates kept."""
    import re

    return [t for t in re.split(r"[^a-z0-9_$]+", q.lower()) if t]


def lexical(files: DataFrame, q: str, limit: int = 20, weighting: str = "fixed") -> DataFrame:
    """kind, path, line, title, score of the best files and lines. weighting: "fixed" (20 for the phrase, 5
    for a token) or "length" (twice the phrase's length, a token's length). An empty query has no
    rows."""
    phrase, tokens = q.strip().lower(), query_tokens(q)
    if not tokens:
        return files.limit(0).select(F.lit("").alias("kind"), "path", F.lit(0).cast("long").alias("line"), F.lit("").alias("title"), F.lit(0).cast("long").alias("score"))
    whole, each = (20, [5] * len(tokens)) if weighting == "fixed" else (2 * len(phrase), [len(t) for t in tokens])
    s = lambda c: X.phrase_score(c, phrase, tokens, whole, each)
    found = X.lines(files).withColumn("own", s(F.col("line_text"))).where("own > 0")
    by_line = found.select(F.lit("line").alias("kind"), "path", "line", X.excerpt(F.col("line_text")).alias("title"), (F.col("own") + s(F.col("path"))).cast("long").alias("score"))
    named = files.withColumn("own", 2 * s(F.concat_ws(" ", "path", "language"))).where("own > 0")
    by_file = named.select(F.lit("file").alias("kind"), "path", F.lit(0).cast("long").alias("line"), F.col("path").alias("title"), F.col("own").cast("long").alias("score"))
    return by_line.unionByName(by_file).orderBy(F.desc("score"), "path", "line", "kind").limit(limit)


def semantic_index(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each record's stems, sorted and joined."""
    tokens = X.semantic_tokens(F.col(text_col))
    return records.select(id_col, F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, "\n"), 256).alias("tokens_sha256"))


def semantic(records: DataFrame, id_col: str, text_col: str, q: str, limit: int = 20) -> DataFrame:
    """Share of the query's stems that a record has, and 2 more if it has the query itself."""
    want = X.semantic_tokens(F.lit(q))
    share = F.size(F.array_intersect(want, X.semantic_tokens(F.col(text_col)))) / F.size(want)
    score = F.round(share + F.when(F.lower(text_col).contains(q.strip().lower()), 2.0).otherwise(0.0), 4)
    return records.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(limit)


def normal_score(s: Column) -> Column:
    return F.least(F.lit(1.0), s / F.greatest(s, F.lit(20.0)))


def hybrid(lexical_rows: DataFrame, semantic_rows: DataFrame, exact: Column, limit: int = 20) -> DataFrame:
    """Rows (key, title, score) of two searches in one ranking: the better normalised score, the exact bonus
    for each merge and once more at the end, and a bonus for being found twice."""
    bonus = F.when(exact, 0.3).otherwise(0.0)
    a = lexical_rows.select("key", "title", normal_score(F.col("score").cast("double")).alias("a"))
    b = semantic_rows.select("key", F.col("title").alias("title_b"), normal_score(F.col("score").cast("double")).alias("b"))
    both = a.join(b, "key", "full_outer").withColumn("title", F.coalesce("title", "title_b"))
    first = F.when(F.col("a").isNotNull(), F.col("a") + bonus)
    second = F.when(F.col("b").isNotNull(), F.greatest(F.coalesce(first, F.lit(0.0)), F.col("b")) + bonus).otherwise(first)
    n = F.when(F.col("a").isNotNull(), 1).otherwise(0) + F.when(F.col("b").isNotNull(), 1).otherwise(0)
    score = F.round(second + bonus + F.when(n > 1, 0.15).otherwise(0.0), 4)
    return both.select("key", score.alias("score"), n.cast("long").alias("n_sources")).orderBy(F.desc("score"), "key").limit(limit)


def retrieval_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """precision, recall and mean reciprocal rank of ranked (key, rank) against expected keys."""
    hit = expected.join(ranked, "key", "left")
    n = ranked.agg(F.count("*").alias("n_ranked"))
    m = hit.agg(F.count("*").alias("n_expected"), F.count("rank").alias("n_hit"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    # one row on either side
    return m.join(n, F.lit(True)).select("n_ranked", "n_expected", "n_hit", ratio("n_hit", "n_ranked").alias("precision"), ratio("n_hit", "n_expected").alias("recall"), "mrr")
