"""License scans by diagonal voting.

Every run of K words of every document is hashed; Spark joins all of these rolling hashes to the
template positions that have the same K words, and the words themselves are compared in the join,
so that a hash collision can't vote. A vote lies on the diagonal (document position - template
position). Votes are summed by diagonal; the diagonals of a template that lie near one another
(a word put in or left out moves the match to the next diagonal) are merged into one span, which
is verified: the distinct template positions that it holds, in rising order along the document,
must cover the template's share. A phrase that must stand word for word needs all of its votes on
one diagonal.

Cases: null and empty texts have no words; a document shorter than a template can't cover it;
each row gives a row, also where rows repeat in id and text; input columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import ALNUM, tuned, word_chunks

#: Words of a rolling hash.
K = 2
#: Diagonals this far apart, in words, belong to one span.
NEAR = 3
#: The share of a loose template's K-grams that a span must hold.
COVER = 0.85

# Phrases whose places are counted word for word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer wordings, matched loosely, and the labels that they add.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}


def template_rows(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(template id, label, exact, votes needed, position, hash, word, next word) of every template position."""
    rows = []
    for tid, (text, label, exact) in enumerate([*((t, n, True) for t, n in phrases.items()), *((t, n, False) for t, n in templates.items())]):
        (_, _, w), = word_chunks(pa.array([text]), ALNUM)
        at, h = w.grams(K)
        words = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
        rows += [(tid, label, exact, len(at), int(k), int(x), words[k], words[k + 1]) for k, x in zip(at, h.view(np.int64))]
    return rows


TEMPLATE_SCHEMA = "tid int, label string, exact boolean, votes int, t_at int, hash long, word string, next string"


def rolling(source: DataFrame) -> DataFrame:
    """(id, key, at, hash, word, next) of every run of K words of id and text, and for each row one
    with at -1 and the number of words as its hash. key: a hash of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in word_chunks(b.column(2), ALNUM):
                at, h = w.grams(K)
                ids, keys = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                row = w.row[at]
                first = w.first
                # all words in one buffer; a word and its successor are two views of it
                size = w.end - w.start
                offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                chars = pa.py_buffer(w.data[ALNUM[w.data]].tobytes())
                n = len(size)
                word = pa.StringArray.from_buffers(n, pa.py_buffer(offs), chars)
                after = pa.StringArray.from_buffers(max(n - 1, 0), pa.py_buffer(offs[1:].copy()), chars)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.full(hi - lo, -1, np.int32)), pa.array(w.counts), pa.nulls(hi - lo, pa.string()), pa.nulls(hi - lo, pa.string())], ["id", "key", "at", "hash", "word", "next"])
                for a in range(0, len(at), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    pick = pa.array(row[z])
                    yield pa.RecordBatch.from_arrays([ids.take(pick), keys.take(pick), pa.array((at[z] - first[row[z]]).astype(np.int32)), pa.array(h[z].view(np.int64)), word.take(take[z]), after.take(take[z])], ["id", "key", "at", "hash", "word", "next"])

    kind = dict(source.dtypes)["id"]
    return source.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(scan, f"id {kind}, key long, at int, hash long, word string, next string")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """One row per document: id, n_words, spans (array of label, exact, start, end, score; start and
    end in words, end exclusive, by start)."""
    spark = docs.sparkSession
    tuned(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a row for each word of the templates above: bounded by them, not by the data
    known = spark.createDataFrame(template_rows(phrases, templates), TEMPLATE_SCHEMA)
    grams = rolling(source).alias("g")
    hit = (F.col("g.hash") == F.col("t.hash")) & (F.col("g.word") == F.col("t.word")) & (F.col("g.next") == F.col("t.next")) & (F.col("g.at") >= 0)
    votes = grams.join(F.broadcast(known).alias("t"), hit, "left").where(F.col("tid").isNotNull() | (F.col("at") < 0))
    diagonals = votes.groupBy("id", "key", "tid", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.max(F.when(F.col("at") < 0, F.col("g.hash"))).alias("n_words"), F.count(F.when(F.col("at") < 0, 1)).alias("copies"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("votes").alias("votes"),
        # distinct, as rows that repeat in id and text vote once each
        F.size(F.collect_set("t_at")).cast("long").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("t_at").alias("first_t"), F.max("t_at").alias("last_t"),
    )
    # bands of near diagonals, so that a far one between two parts of a span doesn't break it
    across = Window.partitionBy("id", "key", "tid").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(across) > NEAR).cast("int"), F.lit(0))
    diagonals = diagonals.withColumn("apart", apart).withColumn("band", F.sum("apart").over(across))
    place = Window.partitionBy("id", "key", "tid", "band").orderBy("first_at", "diagonal")
    # near diagonals that go on where the last one ended, in the document and in the template
    goes_on = ~F.col("exact") & (F.abs(F.col("diagonal") - F.lag("diagonal").over(place)) <= NEAR) & (F.col("first_t") > F.lag("last_t").over(place)) & (F.col("first_at") <= F.lag("last_at").over(place) + K + NEAR)
    merged = (
        diagonals.withColumn("new", F.when(F.col("tid").isNull(), 0).otherwise((~F.coalesce(goes_on, F.lit(False))).cast("int")))
        .withColumn("span", F.sum("new").over(place))
        .groupBy("id", "key", "tid", "band", "span")
        .agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("votes").alias("votes"), F.sum("n").alias("n"), F.min("first_at").alias("start"), F.max(F.col("last_at") + K).alias("end"))
    )
    score = F.col("n") / F.col("votes")
    good = F.col("tid").isNotNull() & F.when(F.col("exact"), F.col("n") == F.col("votes")).otherwise(score >= cover)
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "exact", F.least(score, F.lit(1.0)).alias("score"))
    texts = merged.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.when(good, span))).alias("spans"))
    return texts.select("id", "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document against all phrases and templates."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
