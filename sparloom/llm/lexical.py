"""Ranked lexical search over a bit-sliced impact index.

The index holds the documents in blocks of at most BLOCK_DOCS, in ascending order of id within a block. For each
block and term it has one row: where in the block the term occurs, and bitmaps over these places, one for each bit
of the term's impact there (its saturated, length-normalised frequency). A search reads the rows of its terms only,
opens them to bitmaps over the block, multiplies them by the term's weight by shifted additions, and adds the terms
of a query, all by bitwise carry arithmetic on 64 documents a word. The best k of a block are found from the most
significant slice downwards; the blocks' best meet in a window by query.

Cases: null and empty texts hold no term, match nothing and don't count as documents; each row of the documents is
a document of its own, rows that repeat an id included; a null id ranks before others at equal scores; each row of
the queries is a query of its own, one without terms has no results; empty tables give no rows. Input columns of
other names are ignored. A text of any length is read in pieces cut between terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import ALNUM, CHUNK_BYTES, Words, column_bytes, lean, row_chunks, segment, stored, tuned

#: Documents in a block, at most; places in a block take 16 bits.
BLOCK_DOCS = 1 << 14
#: Pairs of document and term after which a block is closed.
BLOCK_PAIRS = 1 << 21
#: Bits of an impact, which is below a million.
IMPACT_BITS = 20
#: Pairs of query and term that one pass over the index handles.
PAIRS_PER_PASS = 500_000
#: Queries whose sums are held at once.
QUERIES_AT_ONCE = 16
#: Rows of the index in one Arrow batch.
BATCH_TERMS = 1 << 15

_WORD = ALNUM.copy()
_WORD[65:91] = True


@dataclass
class Index:
    """rows: block, term (hash; null in a block's first row), df, data, ids; counts of documents and terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that one document gives a term, before the term's weight."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    """The weight of a term that df documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pieces(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of groups of rows; a longer row comes in several pieces, cut between terms."""
    data, offs = column_bytes(col)
    for lo, hi in row_chunks(offs):
        at, end = int(offs[lo]), int(offs[hi])
        if hi - lo > 1 or end - at <= 2 * CHUNK_BYTES:
            yield lo, hi, segment(data[at:end], offs[lo : hi + 1] - at, ALNUM)
            continue
        while at < end:
            stop = min(end, at + CHUNK_BYTES)
            while stop < end and _WORD[data[stop]]:
                gap = np.flatnonzero(~_WORD[data[stop : stop + 4096]])
                stop += int(gap[0]) if len(gap) else min(4096, end - stop)
            yield lo, hi, segment(data[at:stop], np.array([0, stop - at]), ALNUM)
            at = stop


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(0))
            some = many = 0
            for lo, hi in row_chunks(offs, 1 << 20):
                m = _WORD[data[offs[lo] : offs[hi]]]
                head = m.copy()
                head[1:] &= ~m[:-1]
                first = offs[lo:hi][offs[lo:hi] < offs[lo + 1 : hi + 1]] - offs[lo]
                head[first] = m[first]
                upto = np.concatenate([[0], np.cumsum(head)])[offs[lo : hi + 1] - offs[lo]]
                some += int((np.diff(upto) > 0).sum())
                many += int(upto[-1])
            yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([many], pa.int64())], ["docs", "terms"])

    got = docs.select(text_col).mapInArrow(lean(scan), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


class Block:
    """The postings of the documents of one block, until it is closed."""

    def __init__(self):
        self.ids, self.parts, self.n_rows, self.n_pairs = [], [], 0, 0

    def add(self, row: np.ndarray, term: np.ndarray) -> None:
        """Terms of rows; each pair of them is kept once, with its count."""
        order = np.lexsort((row, term))
        row, term = row[order], term[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else order
        self.parts.append((row[new], term[new], np.diff(np.append(new, len(row)))))
        self.n_pairs += len(new)

    def rows(self, number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The index's rows of this block."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, term, tf = (np.concatenate(x) for x in zip(*self.parts))
        if len(row) == 0:
            return
        n = np.bincount(row, tf, self.n_rows).astype(np.int64)
        row = place[row]
        order_in = np.lexsort((row, term))
        n, row, term, tf = n[order], row[order_in], term[order_in], tf[order_in]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
        row, term, tf = row[new], term[new], np.add.reduceat(tf, new)
        value = impact(tf, n[row], n_docs, n_terms)
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        names, kind = ["block", "term", "df", "data", "ids"], pa.list_(ids.type)
        first = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), pa.nulls(1, pa.binary()), first], names)
        ends = np.append(head, len(row))
        for lo in range(0, len(head), BATCH_TERMS):
            hi = min(lo + BATCH_TERMS, len(head))
            a, z = ends[lo], ends[hi]
            df = np.diff(ends[lo : hi + 1])
            data, offs = packed(df, row[a:z], value[a:z])
            blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, number)), pa.array(term[head[lo:hi]].view(np.int64)), pa.array(df.astype(np.int32)), blob, pa.nulls(hi - lo, kind)], names)


def packed(df: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term (of df postings) its places, 16 bits each, then the bitmaps of the values' bits; with offsets."""
    width = (df + 7) // 8
    offs = np.concatenate([[0], np.cumsum(2 * df + IMPACT_BITS * width)])
    out = np.zeros(offs[-1], np.uint8)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(df) - df, df)
    at = np.repeat(offs[:-1], df) + 2 * nth
    out[at], out[at + 1] = place & 255, place >> 8
    padded = np.zeros(8 * width.sum(), np.uint32)
    padded[8 * np.repeat(np.cumsum(width) - width, df) + nth] = value
    at = np.repeat(offs[:-1] + 2 * df - (np.cumsum(width) - width), width) + np.arange(width.sum())
    step = np.repeat(width, width)
    for s in range(IMPACT_BITS):
        out[at + s * step] = np.packbits((padded >> s).astype(np.uint8) & 1, bitorder="little")
    return out, offs


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all terms of all documents, written to the shared folder. Nothing is shuffled."""
    tuned(docs.sparkSession)
    n_docs, n_terms = totals(docs, text_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for b in batches:
            last = -1
            for lo, hi, w in pieces(b.column(1)):
                if lo > last and block.n_rows and (block.n_rows + hi - lo > BLOCK_DOCS or block.n_pairs >= BLOCK_PAIRS):
                    yield from block.rows(number, n_docs, n_terms)
                    number, block = number + 1, Block()
                if lo > last:
                    block.ids.append(b.column(0).slice(lo, hi - lo))
                    block.n_rows += hi - lo
                    last = lo
                block.add(w.row + block.n_rows - (hi - lo), w.hash)
        if block.n_rows:
            yield from block.rows(number, n_docs, n_terms)

    rows = source.mapInArrow(lean(scan), f"block long, term long, df int, data binary, ids array<{dict(source.dtypes)['id']}>")
    return Index(stored(rows, "lexical"), n_docs, n_terms)


def opened(data: list[bytes], df: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps [slice, term, word] over a block of 64 * width places."""
    term = np.repeat(np.arange(len(data)), df)
    place = np.concatenate([np.frombuffer(x, "<u2", n) for x, n in zip(data, df.tolist())])
    bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=2 * n).reshape(IMPACT_BITS, -1), axis=1, count=n, bitorder="little") for x, n in zip(data, df.tolist())]
    bits = np.concatenate(bits, axis=1)
    out = np.zeros((IMPACT_BITS, len(data), width), np.uint64)
    dense = np.zeros((len(data), 64 * width), np.uint8)
    for s in range(IMPACT_BITS):
        dense[term, place] = bits[s]
        out[s] = np.packbits(dense, axis=1, bitorder="little").view("<u8")
    return out


def add(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """total += more << shift, for bitmaps by slice: sum and carry of each slice go into the next."""
    carry = np.zeros(total.shape[1:], np.uint64)
    for s in range(shift, len(total)):
        if s - shift < len(more):
            x, y = total[s], more[s - shift]
            half = x ^ y
            both = x & y
            both |= half & carry
            total[s] = half ^ carry
            carry = both
        elif not carry.any():
            return
        else:
            total[s], carry = total[s] ^ carry, total[s] & carry


def weighted(bits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bitmaps of impact times weight: one shifted addition for each bit of the weights."""
    top = int(weights.max()).bit_length()
    out = np.zeros((len(bits) + top, *bits.shape[1:]), np.uint64)
    for b in range(top):
        some = np.flatnonzero(weights >> b & 1)
        if len(some):
            part = out[:, some]
            add(part, bits[:, some], b)
            out[:, some] = part
    return out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's k highest positive sums [slice, query, word]; of equal sums at the
    end of the k, those of the first places."""
    sure = np.zeros(total.shape[1:], np.uint64)
    equal = np.bitwise_or.reduce(total, axis=0)
    for s in range(len(total) - 1, -1, -1):
        more = sure | (equal & total[s])
        few = (np.bitwise_count(more).sum(axis=1) < k)[:, None]
        sure = np.where(few, more, sure)
        equal = np.where(few, equal & ~total[s], equal & total[s])
    as_bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    sure, equal = as_bits(sure), as_bits(equal).astype(np.int32)
    rest = k - sure.sum(axis=1, dtype=np.int64)
    query, place = np.nonzero(sure | ((np.cumsum(equal, axis=1) <= rest[:, None]) & (equal > 0)))
    bits = total[:, query, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
    return query, place, (bits << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


def best_of_block(queries: list[tuple[int, list[int]]], weights: dict[int, int], rows: dict[int, tuple[int, bytes]], n_docs: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, place, score) of the best documents of one block, for some queries at a time."""
    width = (n_docs + 63) // 64
    here = [(q, x) for q, terms in queries if (x := [t for t in terms if t in rows and weights[t] > 0])]
    for lo in range(0, len(here), QUERIES_AT_ONCE):
        some = sorted(here[lo : lo + QUERIES_AT_ONCE], key=lambda x: -len(x[1]))
        terms = sorted({t for _, x in some for t in x})
        at = {t: i for i, t in enumerate(terms)}
        bits = weighted(opened([rows[t][1] for t in terms], np.array([rows[t][0] for t in terms]), width), np.array([weights[t] for t in terms]))
        longest = len(some[0][1])
        total = np.zeros((len(bits) + longest.bit_length(), len(some), width), np.uint64)
        for j in range(longest):
            n = sum(len(x) > j for _, x in some)
            add(total[:, :n], bits[:, [at[x[j]] for _, x in some[:n]]])
        query, place, score = best(total, k)
        yield np.array([q for q, _ in some])[query], place, score


def passes(queries: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, list[int]]]]:
    """The queries with terms, (id, distinct terms), in lists of ``limit`` pairs; the driver holds one list."""
    source = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms: list[set[int]] = [set() for _ in range(b.num_rows)]
            for lo, hi, w in pieces(b.column(1)):
                ends = w.first
                for k in range(hi - lo):
                    terms[lo + k].update(w.hash[ends[k] : ends[k + 1]].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(x) for x in terms], pa.list_(pa.int64()))], ["id", "terms"])

    held, size = [], 0
    for row in source.mapInArrow(scan, f"id {dict(source.dtypes)['id']}, terms array<long>").where("size(terms) > 0").toLocalIterator():
        if held and size + len(row["terms"]) > limit:
            yield held
            held, size = [], 0
        held.append((row["id"], row["terms"]))
        size += len(row["terms"])
    if held:
        yield held


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", limit: int = PAIRS_PER_PASS) -> DataFrame:
    """id, rank, document and score of each query's k best documents. Queries go through the index in passes of
    ``limit`` pairs of query and term; only a pass's queries and the counts of its terms meet on the driver."""
    spark = index.rows.sparkSession
    tuned(spark)
    kind = dict(queries.dtypes)[id_col]
    doc_kind = dict(index.rows.dtypes)["ids"].removeprefix("array<")[:-1]
    out = spark.createDataFrame([], f"query long, id {kind}, doc {doc_kind}, score long")
    first = 0
    for held in passes(queries, id_col, text_col, limit):
        terms = spark.createDataFrame(pa.table({"term": pa.array(sorted({t for _, x in held for t in x}), pa.int64())}))
        rows = index.rows.join(F.broadcast(terms), "term", "left_semi").select(index.rows.columns)
        weights = {t: weight(df, index.n_docs) for t, df in rows.groupBy("term").agg(F.sum("df")).collect()}
        sent = spark.sparkContext.broadcast(([(first + i, x) for i, (_, x) in enumerate(held)], weights))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, weights = sent.value

            def close() -> Iterator[pa.RecordBatch]:
                for query, place, score in best_of_block(queries, weights, held, len(ids), k):
                    yield pa.RecordBatch.from_arrays([pa.array(query), ids.take(pa.array(place)), pa.array(score)], ["query", "doc", "score"])

            block, ids, held = None, None, {}
            for b in batches:
                blocks, term, df = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
                for i in range(b.num_rows):
                    if blocks[i] != block:
                        if held:
                            yield from close()
                        block, held = blocks[i], {}
                    if not term[i].is_valid:
                        ids = b.column(4)[i].values
                    else:
                        held[term[i].as_py()] = (int(df[i]), b.column(3)[i].as_py())
            if held:
                yield from close()

        # a block's own row comes first, then those of the terms
        together = rows.unionByName(index.rows.where("term IS NULL")).repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
        ranked = together.mapInArrow(lean(scan), f"query long, doc {doc_kind}, score long")
        names = spark.createDataFrame([(first + i, x) for i, (x, _) in enumerate(held)], f"query long, id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("query", "id", "doc", "score"))
        first += len(held)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("id").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 50 best documents for each benchmark item."""
    return search(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH words AS (SELECT rowid AS r, doc_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
tfs AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
WHERE rank <= 50"""
