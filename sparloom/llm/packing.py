"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document is its tokens and one end. Whole windows are cut off its front; what is left, less than a window, is dealt
with in pools of POOL windows, as they come in a task. Within a pool every rest begins as a partial partition of its
own; the two partial partitions of the largest imbalance are merged again and again, the fullest window of one with
the emptiest of the other, until one partition with near-equal windows is left. The number of windows is what the
pool's tokens need; it rises by one whenever a window exceeds the capacity. As documents may be cut (``cut``), a pool
is filled up with the front of its last rest and a window's surplus first moves to windows that have room: then the
count needn't rise, and a task pads less than one window in all. Without ``cut``, rests stay whole and the count rises.

Tokens are those of the tokenizer's JSON file as the library of that name gives them, with its special strings as
ordinary text: byte-level merges never reach over a single space between two other characters, so that words are
looked up, and new words are encoded together.

Cases: null and empty texts are one end; rows that repeat are packed each by itself; ids may be of any type and null;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import column_bytes, lean, row_chunks, tuned

#: Tokens of a window.
WINDOW = 1024
#: Windows whose rests are dealt out together.
POOL = 64
#: Words kept with their ids in a worker, each of so many characters at most.
KEPT_WORDS, KEPT_LENGTH = 200_000, 40
RANK_FILE = "byte_bpe_50k.tiktoken"

_words = re.compile(r"(?<=\S) (?=\S)").split


class Encoder:
    """Ids of texts, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, r in ranks.items():
            self.length[r] = len(piece)
        self.kept: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.codec.encode_ordinary(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each after a space, encoded as one text and cut where words end."""
        if not words:
            return {}
        raw = self.codec.encode_to_numpy(" " + " ".join(words)).astype("<u4")
        ends = np.searchsorted(np.cumsum(self.length[raw]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        whole, starts = raw.tobytes(), [0, *(4 * ends).tolist()]
        return {w: whole[a:z] for w, a, z in zip(words, starts, starts[1:])}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_words(x) for x in texts]
        ids = self.kept
        new = self.learn(list(set().union(*(s[1:-1] for s in split)) - ids.keys()))
        if len(ids) + len(new) > KEPT_WORDS:
            ids = {w: ids[w] for w in set().union(*(s[1:-1] for s in split)) & ids.keys()}
            self.kept = dict(ids)
        self.kept.update((w, x) for w, x in new.items() if len(w) <= KEPT_LENGTH)
        long = {w: x for w, x in new.items() if len(w) > KEPT_LENGTH}
        ids = self.kept | long if long else self.kept
        out = []
        for s in split:
            last = self.ids(" " + s[-1]) if len(s) > 1 else b""
            out.append(self.ids(s[0]) + b"".join([ids[w] for w in s[1:-1]]) + last)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder for each rank file and pattern in a worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the numbers of sizes, with near-equal sums.

    A partial partition is a list of (sum above its least, members), sums descending; groups without members are
    left out while there are fewer than k."""
    if not sizes:
        return []
    parts = [(-s, n, [(s, n)]) for n, s in enumerate(sizes)]
    heapq.heapify(parts)
    made = len(parts)
    while len(parts) > 1:
        a, b = heapq.heappop(parts)[2], heapq.heappop(parts)[2]
        over = max(0, len(a) + len(b) - k)  # groups that both have
        alone, other = len(a) - over, len(b) - over
        merged = a[:alone] + [(x + y, (m, n)) for (x, m), (y, n) in zip(a[alone:], reversed(b[other:]))] + b[:other]
        merged.sort(key=lambda g: -g[0])
        least = merged[-1][0] if len(merged) == k else 0
        if least:
            merged = [(s - least, m) for s, m in merged]
        heapq.heappush(parts, (-merged[0][0], made, merged))
        made += 1
    out = []
    for _, tree in parts[0][2]:
        group, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                group.append(x)
        out.append(sorted(group))
    return out


def dealt(sizes: list[int], window: int, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Windows of (number of the size, from, to), none larger than ``window``."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        groups = [[(n, 0, sizes[n]) for n in g] for g in differencing(sizes, k)]
        if cut:
            groups += [[] for _ in range(k - len(groups))]
            level(groups, window)
        if all(sum(z - a for _, a, z in g) <= window for g in groups):
            return [g for g in groups if g]
        k += 1


def level(groups: list[list[tuple[int, int, int]]], window: int) -> None:
    """Move what windows have above the capacity, from the end of their largest part, to windows that have room."""
    room = [(window - s, g) for g in groups if (s := sum(z - a for _, a, z in g)) < window]
    for g in groups:
        more = sum(z - a for _, a, z in g) - window
        while more > 0 and room:
            at = max(range(len(g)), key=lambda i: g[i][2] - g[i][1])
            n, a, z = g[at]
            free, other = room.pop()
            step = min(more, free, z - a)
            other.append((n, z - step, z))
            if z - step > a:
                g[at] = (n, a, z - step)
            else:
                g.pop(at)
            more -= step
            if free > step:
                room.append((free - step, other))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = 0, cut: bool = True, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids (array<int>; if with_ids), ids_crc32, doc_tokens, sequence_id, offset.
    Nothing is shuffled; a task packs its own documents. path: a rank file that every executor can open."""
    tuned(docs.sparkSession)
    path = path or public_tokenizers.path(RANK_FILE)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    last = np.array([end], "<u4").tobytes()
    names = ["id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sequence, id_type = encoder_of(path, pattern), TaskContext.get().partitionId() << 32, None
        rows: list[tuple] = []  # of pieces that have their place
        rests: list[tuple] = []  # id, start, raw ids, tokens of the document
        held = 0

        def place(windows: list[list[tuple]]) -> None:
            nonlocal sequence
            for w in windows:
                at = 0
                for i, start, raw, total in w:
                    rows.append((i, start, len(raw) // 4, raw, zlib.crc32(raw), total, sequence, at))
                    at += len(raw) // 4
                sequence += 1

        def close(full: bool) -> None:
            """Deal out the rests; if full, as many tokens as fill the pool."""
            nonlocal rests, held
            now, rests = rests, []
            if full and cut and held > POOL * window:
                i, start, raw, total = now[-1]
                keep = len(raw) - 4 * (held - POOL * window)
                now[-1] = (i, start, raw[:keep], total)
                rests = [(i, start + keep // 4, raw[keep:], total)]
            held = sum(len(r[2]) // 4 for r in rests)
            groups = dealt([len(r[2]) // 4 for r in now], window, cut)
            place([[(now[n][0], now[n][1] + a, now[n][2][4 * a : 4 * z], now[n][3]) for n, a, z in g] for g in groups])

        def given() -> pa.RecordBatch:
            i, start, length, raw, crc, total, seq, at = zip(*rows)
            cols = [pa.array(i, id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))))
            cols += [pa.array(x, pa.int64()) for x in (crc, total, seq, at)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            id_type = b.column(0).type
            data, offs = column_bytes(b.column(1))
            for lo, hi in row_chunks(offs):
                ids = b.column(0).slice(lo, hi - lo).to_pylist()
                for i, raw in zip(ids, encoder.encode([data[offs[k] : offs[k + 1]].tobytes().decode() for k in range(lo, hi)])):
                    raw += last
                    total = len(raw) // 4
                    whole = total - total % window
                    place([[(i, s, raw[4 * s : 4 * (s + window)], total)] for s in range(0, whole, window)])
                    if total > whole:
                        rests.append((i, whole, raw[4 * whole :], total))
                        held += total - whole
                    if held >= POOL * window:
                        close(True)
                if rows:
                    yield given()
        if rests:
            close(False)
            yield given()

    schema = f"id {kind}, start long, length long, {'ids array<int>, ' * with_ids}ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(lean(scan), schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, ids, length (without padding): the pieces put together, padded to the window unless their length
    is a power of two. A group is one window at most."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("length"))
    full = F.expr("bit_count(length) = 1") | (F.col("length") >= window)
    padding = F.array_repeat(F.lit(pad), (F.lit(window) - F.col("length")).cast("int"))
    return whole.select("sequence_id", F.when(full, F.col("ids")).otherwise(F.concat("ids", padding)).alias("ids"), "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, packed into windows of 1,024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).withColumnRenamed("id", "doc_id")
