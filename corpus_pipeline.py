"""A document pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``docs``. Rows are told apart by doc_id and text, so that repeated ids are no trouble.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.llm import bpe, decontamination, jaccard, quality, secrets
from sparloom.llm.textcore import stored

#: Ids to take out, up to which they are handed to every task instead of joined by shuffle.
BROADCAST_ROWS = 500_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on ``labels``, scores 0.5 at least."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; documents without
    words are in no group and stay."""
    row = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    groups = stored(jaccard.grouped(docs.select(row.alias("row"), "text"), "row"), "groups")
    gone = groups.where("component_id.doc_id IS DISTINCT FROM id.doc_id OR component_id.text_hash IS DISTINCT FROM id.text_hash").select("id.*").distinct()
    # rows that repeat in id and text: all copies but one go
    again = stored(groups.where("n_shingles > 0").groupBy("id").count().where("count > 1").select("id.*"), "repeats")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    mark = "text_hash"
    while mark in docs.columns:
        mark += "_"
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[mark] == b["text_hash"])
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(gone, same(marked, gone), "left_anti")
    if not again.isEmpty():
        repeated = kept.join(again, same(kept, again), "left_semi")
        one = repeated.withColumn(mark + "_nth", F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("doc_id"))).where(f"{mark}_nth = 1").drop(mark + "_nth")
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark."""
    return secrets.redact(docs, length_col="n_chars")


def byte_pair_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and what they decode to."""
    return bpe.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_pair_encoding),
]

#: A trained classifier and the tokenizer can't be written in SQL; tests/llm holds run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
