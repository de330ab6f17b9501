"""Improbable-feature digests of documents.

A feature is a window of WINDOW bytes. Its entropy level is the number of equal pairs of bytes in
it (the collision entropy). How often each level occurs is counted over all documents, and the
rarer a window's level, the higher it ranks; windows of almost one byte come last. Among every
SPAN neighbouring windows the leftmost of the highest rank is elected, and a window elected
often enough is a feature of the text. A text's distinct features go in order into Bloom filters
of FILTER_BITS bits, FEATURES to a filter, one filter chained to the next; the filters in base64
are the fingerprint. Two fingerprints are compared filter by filter: the bits that two filters
share, less those that chance would give, over the most that they could share. Each filter of the shorter
chain counts by its best partner; of chains of equal length, both ways, so that likeness is symmetric.

Cases: null texts count as empty; an empty text has an empty fingerprint, which is like another
empty one (1) and like no other (0); a text shorter than a window is one feature, in one shorter than
SHORT bytes all windows are; ids may be of any type that Spark sorts (strings by their bytes); rows with
equal ids follow one another by a hash of the text; null ids come last; a table of one row has itself as
next. Input columns of other names are ignored. Rows equal in id and text stay in one run, all others are
dealt to runs of about RUN_BYTES, however many share an id.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore
from .textcore import CHUNK_BYTES, column_bytes, mix, row_chunks, tuned

#: Bytes of a window, and the levels that it can have.
WINDOW = 16
LEVELS = WINDOW * (WINDOW - 1) // 2 + 1
#: Windows of this level and above are almost one byte.
FLAT = 50
#: Neighbouring windows that elect one, and elections that make a feature.
SPAN, ELECTED = 64, 16
#: Bytes below which all of a text's windows are features.
SHORT = 4 * SPAN
#: Bits of a filter, features in it, and bits of a feature.
FILTER_BITS, FEATURES, BITS = 2048, 128, 5
#: Bytes of text in a run of neighbouring documents, about, and documents looked at for each bound.
RUN_BYTES, LOOKED_AT = 8 << 20, 16
#: Runs at most, so that what the driver sees of them has a bound; beyond, runs are longer. A run is read in turn, never held.
MOST_RUNS = 20_000


def _inner(offs: np.ndarray) -> np.ndarray:
    """The places at which a window lies inside one row."""
    size = np.maximum(np.diff(offs) - WINDOW + 1, 0)
    return np.arange(size.sum()) + np.repeat(offs[:-1] - (np.cumsum(size) - size), size)


def levels(data: np.ndarray) -> np.ndarray:
    """The level of the window at each place."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pairs = np.zeros(n, np.int32)
    for d in range(1, WINDOW):
        same = np.zeros(len(data) - d + 1, np.int32)
        np.cumsum(data[d:] == data[:-d], out=same[1:], dtype=np.int32)
        pairs += same[WINDOW - d :][:n] - same[:n]
    return pairs


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all documents have each level."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            data, offs = column_bytes(b.column(0))
            for lo, hi in row_chunks(offs):
                total += np.bincount(levels(data[offs[lo] : offs[hi]])[_inner(offs[lo : hi + 1] - offs[lo])], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(scan, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS, np.int64)
    for r in rows:
        out[r["level"]] = r["n"]
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: 0 for the rarest; flat levels come last."""
    order = sorted(range(LEVELS), key=lambda k: (k >= FLAT, counts[k], k))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's features, each once, in order of first place."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = [np.zeros(0, np.uint64)] * len(texts)
    size = np.diff(offs)
    for k in np.flatnonzero((size > 0) & (size < WINDOW)).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(texts[k], digest_size=8).digest(), "<u8")
    at = _inner(offs)
    if not len(at):
        return out
    row = np.searchsorted(offs[1:], at, "right")
    key = ranks[levels(data)[at]] << 40 | np.arange(len(at))
    count = np.zeros(len(at), np.int64)
    low, step = key, 1
    while step < SPAN and len(low) > step:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step == SPAN and len(low):
        whole = row[: len(low)] == row[SPAN - 1 : SPAN - 1 + len(low)]
        count += np.bincount(low[whole] & ((1 << 40) - 1), minlength=len(at))
    # in a short text every window is a feature
    short = np.flatnonzero((size >= WINDOW) & (size < SHORT))
    count[np.isin(row, short)] = ELECTED
    # a text whose windows are never elected often enough has its most elected one
    chosen = np.flatnonzero(count >= ELECTED)
    lacking = np.setdiff1d(np.flatnonzero(size >= WINDOW), row[chosen])
    for k in lacking.tolist():
        a, b = np.searchsorted(row, [k, k + 1])
        count[a + int(count[a:b].argmax())] = ELECTED
    if len(lacking):
        chosen = np.flatnonzero(count >= ELECTED)
    up, down = textcore._tables(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textcore._BYTE_KEYS[data] * up[: len(data)])])
        h = mix((total[at[chosen] + WINDOW] - total[at[chosen]]) * down[at[chosen]])
    for k, part in zip(*_split(row[chosen], h)):
        _, first = np.unique(part, return_index=True)
        out[k] = part[np.sort(first)]
    return out


def _split(row: np.ndarray, h: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    named, first = np.unique(row, return_index=True)
    return named.tolist(), np.split(h, first[1:])


def filters(h: np.ndarray) -> np.ndarray:
    """The chained filters of a text's features: rows of FILTER_BITS / 64 words."""
    n = -(-len(h) // FEATURES)
    bits = np.zeros(n * FILTER_BITS, bool)
    base = np.arange(len(h)) // FEATURES * FILTER_BITS
    for k in range(BITS):
        bits[base + ((h >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8").reshape(n, FILTER_BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the shorter chain's filters, of the best normalised overlap."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    near = np.empty((len(a), len(b)))
    for k, (x, n) in enumerate(zip(a, na)):
        chance = n * nb / FILTER_BITS
        near[k] = np.clip((np.bitwise_count(b & x).sum(1, dtype=np.int64) - chance) / np.maximum(np.minimum(n, nb) - chance, 1e-9), 0, 1)
    own = float(np.average(near.max(1), weights=na))
    return own if len(a) < len(b) else (own + float(np.average(near.max(0), weights=nb))) / 2


def written(f: np.ndarray) -> str:
    return base64.b64encode(f.tobytes()).decode()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every document; nothing but the level counts is gathered."""
    tuned(docs.sparkSession)
    ranks = ranks_of(level_counts(docs, text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(1))
            for lo, hi in row_chunks(offs):
                texts = [data[offs[k] : offs[k + 1]].tobytes() for k in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(t.decode()) for t in texts], pa.int64()), pa.array([written(filters(h)) for h in features(texts, ranks)], pa.string())], ["id", "n_chars", "fingerprint"])

    return source.mapInArrow(scan, f"id {dict(source.dtypes)['id']}, n_chars long, fingerprint string")


def in_runs(docs: DataFrame, runs: int) -> tuple[DataFrame, int]:
    """((run, late, id, key, text), number of runs): documents by descending id, then by a hash of the text,
    dealt into runs of neighbours; each run also has, late, the first document of the next run that has
    any. Only the runs' bounds and first documents come to the driver."""
    keyed = docs.withColumn("key", F.xxhash64("text"))
    # a rising order whose reverse is by descending id (null last), then by key
    place = lambda i, key: (i is not None, 0 if i is None else i, ~key)
    look = keyed.select("id", "key").orderBy(F.xxhash64("id", "key", F.lit(7))).limit(LOOKED_AT * runs).collect() if runs > 1 else []
    seen = sorted(place(*r) for r in look)
    bounds = sorted({seen[k * len(seen) // runs] for k in range(1, runs)}) if seen else []

    def run_of(ids: pa.Array, keys: pa.Array) -> np.ndarray:
        """Run 0 has the highest ids; null ids come last."""
        return np.array([len(bounds) - bisect_left(bounds, place(i, k)) for i, k in zip(ids.to_pylist(), keys.to_pylist())], np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(run_of(b.column(0), b.column(1))), *b.columns], ["run", "id", "key"])

    kind = dict(docs.dtypes)["id"]
    last = F.struct(F.col("id").isNotNull().alias("a"), F.col("id").alias("id"), F.bitwise_not("key").alias("c"))
    heads = keyed.select("id", "key").mapInArrow(number, f"run int, id {kind}, key long").groupBy("run").agg(F.max(last).alias("first")).collect()
    named = sorted((r["run"], r["first"]["id"], ~r["first"]["c"]) for r in heads)
    # where each run's first document is also needed: at the end of the run before, and the very
    # first one at the end of the last
    also = {named[k]: named[k - 1][0] for k in range(len(named))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run = run_of(b.column(0), b.column(1))
            at = [(k, also[x]) for k, x in enumerate(zip(run.tolist(), b.column(0).to_pylist(), b.column(1).to_pylist())) if x in also]
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.zeros(len(run), np.int32)), *b.columns], ["run", "late", "id", "key", "text"])
            if at:
                more = b.take(pa.array([k for k, _ in at]))
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r in at], pa.int32()), pa.array(np.ones(len(at), np.int32)), *more.columns], ["run", "late", "id", "key", "text"])

    return keyed.select("id", "key", "text").mapInArrow(deal, f"run int, late int, id {kind}, key long, text string"), len(bounds) + 1


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text (its last third replaced by the
    start of the next document) and of the next document, by descending id."""
    spark = docs.sparkSession
    tuned(spark)
    ranks = ranks_of(level_counts(docs, text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed, runs = in_runs(source, min(MOST_RUNS, -(-size // RUN_BYTES) or 1))
    # a partition for each run, by its number
    placed = placed.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "late", F.col("id").desc_nulls_last(), "key")
    kind = placed.schema["id"].dataType
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

    def compute(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (id, text), the last of them only as the next of the one before."""
        own = [t or "" for _, t in rows]
        edited = []
        for a, b in zip(own, own[1:]):
            cut = len(a) // 3
            edited.append(a[: len(a) - cut] + b[:cut])
        raw = [t.encode() for t in edited]
        made = [filters(h) for h in features([t.encode() for t in own] + raw, ranks)]
        mine, theirs = made[: len(own)], made[len(own) :]
        cols = [[i for i, _ in rows[:-1]], [len(t) for t in own[:-1]], [hashlib.sha256(t).hexdigest() for t in raw], [written(f) for f in mine[:-1]], [written(f) for f in theirs], [likeness(a, b) for a, b in zip(mine, theirs)], [likeness(a, b) for a, b in zip(mine, mine[1:])]]
        kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, here, ended = 0, None, False
        for run, late, i, text in rows_of(batches):
            if run != here:
                held, size, here, ended = [], 0, run, False
            if ended:  # a further copy of the next run's first document
                continue
            held.append((i, text))
            size += len(text or "")
            ended = bool(late)
            if len(held) > 1 and (ended or size >= CHUNK_BYTES):
                yield compute(held)
                held, size = held[-1:], len(text or "")

    return placed.select("run", "late", "id", "text").mapInArrow(scan, f"id {dict(source.dtypes)['id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def to_arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type as convert

    return convert(kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document against its edited text and its successor."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
