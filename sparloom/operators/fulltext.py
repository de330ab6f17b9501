"""A stored full-text index over files and their symbols, apart from the queries that read it.

Postings (token, file or symbol) lie in buckets of their token's checksum; a query opens the buckets of its own tokens
only, makes candidates by their equality, and ranks these by what they contain. Without postings, candidates are all
that contain a token anywhere. Tables are written to a new folder and swapped in. Survey rows: JN-01, SRC-09, SRC-10,
SCH-01, SCH-02, FLT-03.

Rows are rebalanced by lane and bucket before they are written, so that a large lane, and a token of many files, is split
among tasks by its size. How many buckets
there are follows the text's size and changes no result.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..sources import versions as V
from .search import query_tokens

#: Stands for what the facts are drawn by; an index of another version is stale.
EXTRACTOR = "1"
#: Bytes of text for each bucket of postings, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 256 << 20, 8, 4096
WORD_END = r"[^\p{L}\p{N}]"


def _words(c: Column) -> Column:
    """Distinct words of letters and digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), f"{WORD_END}+"), lambda x: x != ""))


def parts(token: str) -> list[str]:
    """The words that a query's token holds; several have to follow one another."""
    return [w for w in re.split(r"[^a-z0-9]+", token) if w]


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def prepared(files: DataFrame, found: DataFrame) -> DataFrame:
    """files (path, language, content) with lane, shard_root, sizes, hash and the names of their symbols by line."""
    names = found.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]), " ").alias("symbols_text"))
    content = F.coalesce("content", F.lit(""))
    out = files.select(
        "path", F.coalesce("language", F.lit("text")).alias("language"), P.lane(F.col("path")).alias("lane"), P.shard_root(F.col("path")).alias("shard_root"),
        F.size(F.split(content, "\n")).cast("long").alias("line_count"), F.octet_length(content).cast("long").alias("byte_length"), F.sha2(content, 256).alias("hash"), content.alias("content"),
    )
    return out.join(names, "path", "left").withColumn("symbols_text", F.coalesce("symbols_text", F.lit("")))


def symbol_rows(found: DataFrame) -> DataFrame:
    return found.select("id", "name", "kind", "path", P.lane(F.col("path")).alias("lane"), "line")


def fingerprint(files: DataFrame) -> Column:
    """A digest of all paths and hashes that adds up in any order; an aggregate over (path, hash)."""
    h = lambda seed: F.xxhash64("path", "hash", F.lit(seed))
    return F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(h(1))), F.sum(h(2).cast("decimal(38,0)")).cast("string"))


def build(files: DataFrame, found: DataFrame, place: str, built_at: str = "", buckets: int | None = None, full_text: bool = True) -> str:
    """Write the index of files (path, language, content) and their symbols; the folder that counts now."""
    spark = files.sparkSession

    def write(folder: str) -> None:
        prepared(files, found).hint("rebalance", "lane").write.partitionBy("lane").parquet(f"{folder}/files")
        symbol_rows(found).hint("rebalance", "lane").write.partitionBy("lane").parquet(f"{folder}/symbols")
        rows, symbols = spark.read.parquet(f"{folder}/files"), spark.read.parquet(f"{folder}/symbols")
        n, size, print_ = rows.agg(F.count("*"), F.coalesce(F.sum("byte_length"), F.lit(0)), fingerprint(rows)).first()
        many = buckets or min(MOST, max(FEWEST, 1 << math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))
        if full_text:
            text = F.concat_ws(" ", "path", "language", "symbols_text", "content")
            named = F.concat_ws(" ", "name", "kind", "path")
            both = rows.select(F.lit("file").alias("part"), F.col("path").alias("key"), "lane", F.explode(_words(text)).alias("token"))
            both = both.unionByName(symbols.select(F.lit("symbol").alias("part"), F.col("id").alias("key"), "lane", F.explode(_words(named)).alias("token")))
            dealt = both.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(many)).cast("int"))
            dealt = dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
            dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
            counts = spark.read.parquet(f"{folder}/postings").groupBy("bucket", "token", "part").agg(F.count("*").alias("n"))
            counts.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/frequencies")
        facts = {"builtAt": built_at, "extractorVersion": EXTRACTOR, "fingerprint": print_, "fileCount": n, "byteLength": size, "symbolCount": symbols.count(), "buckets": many, "ftsAvailable": str(full_text).lower()}
        spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "key string, value string").coalesce(1).write.parquet(f"{folder}/metadata")

    return V.publish(spark, place, write)


def metadata(spark: SparkSession, place: str) -> dict[str, str]:
    """The few facts of a stored index; empty if there is none."""
    return {} if V.current(spark, place) is None else {r["key"]: r["value"] for r in V.opened(spark, place, "metadata").collect()}


def status(spark: SparkSession, place: str, files: DataFrame | None = None) -> DataFrame:
    """One row: present, status (missing, stale, ok), fresh, file_count, symbol_count, byte_length, modes, reasons. An
    index is fresh if its version is this one and, where files are given, its fingerprint is theirs (SRC-10)."""
    m = metadata(spark, place)
    reasons = [] if m else ["MISSING"]
    if m and m["extractorVersion"] != EXTRACTOR:
        reasons.append("EXTRACTOR_VERSION")
    if m and files is not None:
        now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
        if now.agg(fingerprint(now)).first()[0] != m["fingerprint"]:
            reasons.append("FINGERPRINT")
    modes = [] if not m else ["fts", "like"] if m["ftsAvailable"] == "true" else ["like"]
    row = (bool(m), "missing" if not m else "stale" if reasons else "ok", not reasons, int(m.get("fileCount", 0)), int(m.get("symbolCount", 0)), int(m.get("byteLength", 0)), modes, reasons)
    return spark.createDataFrame([row], "present boolean, status string, fresh boolean, file_count long, symbol_count long, byte_length long, modes array<string>, reasons array<string>")


def candidates(spark: SparkSession, place: str, q: str, lanes: list[str] | None = None) -> DataFrame:
    """part, key of the files and symbols that hold a token of the query as whole words. A token of several words asks
    for all of them here; that they follow one another is seen in ``search``."""
    many = int(metadata(spark, place)["buckets"])
    asked = [parts(t) for t in query_tokens(q)]
    words = sorted({w for p in asked for w in p})
    rows = V.opened(spark, place, "postings").where(F.col("bucket").isin(sorted({bucket_of(w, many) for w in words})) & F.col("token").isin(words))
    if lanes is not None:
        rows = rows.where(F.col("lane").isin(lanes))
    if all(len(p) < 2 for p in asked):
        return rows.select("part", "key").distinct()
    held = rows.groupBy("part", "key").agg(F.collect_set("token").alias("held"))  # of the query's words at most
    fits = F.exists(F.array(*[F.array(*map(F.lit, p)) for p in asked if p]), lambda p: F.size(F.array_except(p, F.col("held"))) == 0)
    return held.where(fits).select("part", "key")


def ranked(files: DataFrame, symbols: DataFrame, q: str, weighting: str, limit: int) -> DataFrame:
    """kind, path, line, score, title, excerpt of the best symbols, files and lines (SCH-01, SCH-02). weighting: "fixed"
    (20 for the phrase, 5 a token) or "length" (twice the phrase's length, a token's length)."""
    phrase, tokens = q.lower(), query_tokens(q)
    whole, each = (20, [5] * len(tokens)) if weighting == "fixed" else (2 * len(phrase), [len(t) for t in tokens])
    s = lambda c, with_phrase=True: X.phrase_score(c, phrase if with_phrase else "", tokens, whole, each)
    named = symbols.withColumn("own", s(F.concat_ws(" ", "name", "kind", "path")) + 3 * s(F.col("name"), False)).where("own > 0")
    titled = F.concat_ws(" ", "kind", "name")
    by_symbol = named.select(F.lit("symbol").alias("kind"), "path", F.col("line").cast("long").alias("line"), (F.col("own") + 5).cast("long").alias("score"), titled.alias("title"), F.concat(titled, F.lit(" in "), "path", F.lit(":"), F.col("line").cast("string")).alias("excerpt"))
    scored = files.withColumn("near", (2 * s(F.concat_ws(" ", "path", "language")) + s(F.col("symbols_text"))).cast("long"))
    by_file = scored.where("near > 0").select(F.lit("file").alias("kind"), "path", F.lit(1).cast("long").alias("line"), F.col("near").alias("score"), F.col("path").alias("title"), F.col("path").alias("excerpt"))
    lines = X.lines(scored.select("path", "near", "content"), "content").withColumn("own", s(F.col("line_text"))).where("own > 0")
    trimmed = F.regexp_replace("line_text", r"^\s+|\s+$", "")
    short = F.when(F.length(trimmed) > 160, F.concat(F.substring(trimmed, 1, 157), F.lit("..."))).otherwise(trimmed)
    by_line = lines.select(F.lit("file").alias("kind"), "path", F.col("line").cast("long").alias("line"), (F.col("own") + F.col("near")).cast("long").alias("score"), F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("title"), short.alias("excerpt"))
    out = by_symbol.unionByName(by_file).unionByName(by_line)
    return out.orderBy(F.desc("score"), "path", "line", F.desc("kind"), "title", "excerpt").limit(limit)


def search(spark: SparkSession, place: str, q: str, lanes: list[str] | None = None, limit: int = 10, mode: str = "fts") -> DataFrame:
    """The best rows of the stored index, see ``ranked``; mode "fts" ranks those with whole tokens only, "like" those
    that contain one anywhere. A query without tokens has no rows."""
    files, symbols = V.opened(spark, place, "files"), V.opened(spark, place, "symbols")
    if lanes is not None:
        files, symbols = (x.where(F.col("lane").isin(lanes)) for x in (files, symbols))
    tokens = query_tokens(q)
    if not tokens or limit <= 0:
        return ranked(files, symbols, "x", "length", 0)
    if mode == "fts":
        some = candidates(spark, place, q, lanes)
        files = files.join(some.where("part = 'file'").select(F.col("key").alias("path")), "path", "left_semi")
        symbols = symbols.join(some.where("part = 'symbol'").select(F.col("key").alias("id")), "id", "left_semi")
        if any(len(parts(t)) > 1 for t in tokens):
            hits = "|".join(f"(?:^|{WORD_END})" + f"{WORD_END}+".join(parts(t)) + f"(?:{WORD_END}|$)" for t in tokens if parts(t))
            files = files.where(F.lower(F.concat_ws(" ", "path", "language", "symbols_text", "content")).rlike(hits))
            symbols = symbols.where(F.lower(F.concat_ws(" ", "name", "kind", "path")).rlike(hits))
    else:
        has = lambda *cols: F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(F.concat_ws(" ", *cols)), t))
        files, symbols = files.where(has("path", "language", "symbols_text", "content")), symbols.where(has("name", "kind", "path"))
    return ranked(files, symbols, q, "length", limit)
