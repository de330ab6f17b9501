"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The symbols are words, a block is two consecutive words, a test string is a window of words. For
each window length there is one shift table: the block that ends at a position tells how far the
search may move on, because no window has that block closer to its end. A shift of zero leads to
the bucket of the windows that end in this block (the suffix hash), which are then compared with
the text word by word, byte by byte. Many rows are searched in step, one cursor each.

Cases: null and empty texts have no words and are never hit; an item without words has no window;
repeated rows are each searched; repeated item ids count once; items with equal text all count; an
item with a null id is searched for like any other, but is not in the lists of items.
Input columns of other names are ignored, those of equal names are not touched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import ALNUM, GRAM_KEYS, Words, column_bytes, lean, mix, segment, tuned, word_chunks

#: Words of a window.
WINDOW = 10
#: Windows searched for in one pass over the documents; more are searched in further passes.
WINDOWS_PER_PASS = 500_000
#: Positions that one cursor searches.
STRIDE = 96


class Searcher:
    """Shift tables, suffix buckets and the test strings of one set of windows."""

    def __init__(self, windows: list[tuple[str | None, list[bytes]]]):
        """windows: (item id as a string, the words); those of a null id hit, but name no item."""
        self.groups = []
        by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, words in windows:
            by_length[len(words)][b" ".join(words)].update(() if item is None else (item,))
        for m, strings in sorted(by_length.items()):
            texts = sorted(strings)
            buf = pa.array(texts, pa.binary())
            w = segment(*column_bytes(buf), ALNUM)
            hashes = w.hash.reshape(len(texts), m)
            size = min(2, m)
            shift: dict[int, int] = {}
            for end in range(size, m + 1):
                for b in self.block(hashes[:, end - size : end]).tolist():
                    shift[b] = min(shift.get(b, m), m - end)
            heads = self.block(hashes[:, :size])
            pairs: dict[int, list[int]] = defaultdict(list)
            for k, p in enumerate(self.pair(self.block(hashes[:, m - size :]), heads).tolist()):
                pairs[p].append(k)
            keys = np.array(sorted(shift), np.uint64)
            self.groups.append((m, size, keys, np.array([shift[k] for k in keys.tolist()], np.int64), np.array(sorted(pairs), np.uint64), dict(pairs), texts, [frozenset(strings[t]) for t in texts]))

    @staticmethod
    def pair(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(suffix * GRAM_KEYS[3] + prefix)

    @staticmethod
    def block(words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((words * GRAM_KEYS[: words.shape[1]]).sum(axis=1, dtype=np.uint64))

    @staticmethod
    def block_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = words[at] * GRAM_KEYS[0]
            for j in range(1, size):
                h += words[at + j] * GRAM_KEYS[j]
            return mix(h)

    def search(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Per word, whether it is hit; per row with hits, the items found."""
        hit, found = np.zeros(len(w.hash) + 1, np.int64), defaultdict(set)
        first = w.first
        for m, size, keys, shifts, pair_keys, pairs, texts, items in self.groups:
            # the ends (exclusive) of each row's windows, dealt to cursors in runs of STRIDE
            rows = np.flatnonzero(np.diff(first) >= m)
            n_runs = (first[rows + 1] - first[rows] - m) // STRIDE + 1
            row = np.repeat(rows, n_runs)
            run = np.arange(len(row)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
            at = first[row] + m + run * STRIDE
            stop = np.minimum(at + STRIDE - 1, first[row + 1])
            ends = []
            while len(at):
                b = self.block_at(w.hash, at - size, size)
                k = np.minimum(np.searchsorted(keys, b), len(keys) - 1)
                step = np.where(keys[k] == b, shifts[k], m - size + 1)
                zero = step == 0
                if zero.any():
                    # as windows share suffixes, their first block is looked at before the text
                    end = at[zero]
                    p = self.pair(b[zero], self.block_at(w.hash, end - m, size))
                    k = np.minimum(np.searchsorted(pair_keys, p), len(pair_keys) - 1)
                    same = pair_keys[k] == p
                    ends += zip(end[same].tolist(), p[same].tolist())
                at = at + np.maximum(step, 1)
                go = at <= stop
                at, stop = at[go], stop[go]
            for end, p in ends:
                text = w.text(end - m, end)
                for cand in pairs[p]:
                    if texts[cand] == text:
                        hit[end - m] += 1
                        hit[end] -= 1
                        found[int(w.row[end - 1])] |= items[cand]
        return np.cumsum(hit[:-1]) > 0, found


def windows_of(item: object, text: str | None, window: int = WINDOW) -> list[tuple[str | None, list[bytes]]]:
    """The windows of one test item."""
    w = segment(*column_bytes(pa.array([text or ""])), ALNUM)
    words = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
    if not words:
        return []
    return [(None if item is None else str(item), words[k : k + window]) for k in range(max(1, len(words) - window + 1))]


def window_passes(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test set's windows in lists of ``limit`` at most, read one partition at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    some = False
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        new = windows_of(row["i"], row["t"])
        while len(held) + len(new) > limit:
            cut = limit - len(held)
            yield held + new[:cut]
            held, new, some = [], new[cut:], True
        held += new
    if held or not some:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = WINDOWS_PER_PASS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted array of item ids as strings).

    Test sets of up to ``limit`` windows take one pass; a larger one is searched in blocks, whose
    hit word positions are united per document. Either way each row of the documents gives a row."""
    spark = docs.sparkSession
    tuned(spark)
    # each holds ``limit`` windows at most; the driver keeps none of them
    passes = [spark.sparkContext.broadcast(Searcher(x)) for x in window_passes(benchmark, item_col, item_text_col, limit)]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(shared: Broadcast, keep: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for b in batches:
                for lo, hi, w in word_chunks(b.column(1), ALNUM):
                    hit, found = searcher.search(w)
                    n_hit = np.bincount(w.row, hit, hi - lo).astype(np.int64)
                    first = w.first
                    cols = [b.column(0).slice(lo, hi - lo), pa.array(w.counts), pa.array(n_hit), pa.array([sorted(found.get(k, ())) for k in range(hi - lo)], pa.list_(pa.string()))]
                    names = ["id", "n_words", "n_hit", "items"]
                    if keep:
                        cols.append(pa.array([np.flatnonzero(hit[first[k] : first[k + 1]]).tolist() for k in range(hi - lo)], pa.list_(pa.int64())))
                        cols.append(pa.array([hashlib.md5(b.column(1)[lo + k].as_buffer() if b.column(1)[lo + k].is_valid else b"").hexdigest() for k in range(hi - lo)]))
                        names += ["at", "of"]
                    yield pa.RecordBatch.from_arrays(cols, names)

        return scan

    kind = dict(source.dtypes)["id"]
    schema = f"id {kind}, n_words long, n_hit long, items array<string>"
    if len(passes) == 1:
        return source.mapInArrow(lean(run(passes[0], False)), schema)
    united = None
    for p in passes:
        part = source.mapInArrow(lean(run(p, True)), schema + ", at array<long>, of string")
        united = part if united is None else united.unionAll(part)
    # rows equal in id and text have equal hits: one group, given as often as each pass had it
    sides = united.groupBy("id", "of").agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("*").alias("rows"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"rows div {len(passes)}")))
    return sides.select("id", "n_words", "n_hit", "items", copies.alias("copy")).drop("copy")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = WINDOWS_PER_PASS) -> DataFrame:
    """The documents without any test window, with their own columns; nothing is shuffled."""
    tuned(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = docs
    for windows in window_passes(benchmark, item_col, item_text_col, limit):
        shared = docs.sparkSession.sparkContext.broadcast(Searcher(windows))

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for b in batches:
                for lo, hi, w in word_chunks(b.column(at), ALNUM):
                    bad = searcher.search(w)[1]
                    yield b.slice(lo, hi - lo).filter(pa.array([k not in bad for k in range(hi - lo)]))

        out = out.mapInArrow(lean(scan), docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document against every benchmark window."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
