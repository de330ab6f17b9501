"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern; each piece that is not itself a token is merged on its
own. The tokens of a piece stand in a doubly linked list. Every pair that can merge waits in the
bucket of its rank, which holds the list positions of the left halves. Over the ranks lies a
bitmap in three levels of 64-bit words, so that find-first-set on three words gives the lowest
rank in constant time, however long the piece is. An entry whose pair has meanwhile changed is
stale and is skipped when its turn comes. Entries of one rank are taken from left to right. The
pieces of a block of texts share one queue, so that a bucket's entries are merged together.

Pieces recur, so each worker keeps the ids of those met last, up to a bound.

Cases: null texts count as empty; an empty text has no ids and decodes to nothing; unpaired
surrogates can't occur in Spark strings; special tokens in a text are ordinary text; repeated rows
are each encoded; input columns of other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import column_bytes, lean, row_chunks, tuned

#: Default rank file; a parameter of every function here.
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bytes of text whose new pieces are merged together.
BLOCK_BYTES = 2 << 20
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 200_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64


class RankQueue:
    """List positions by merge rank; pop gives all positions in the bucket of the lowest rank."""

    def __init__(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Starts with the positions at[k] in the buckets of ranks[k]."""
        order = np.argsort(ranks, kind="stable")
        self.at = at[order]
        named, first = np.unique(ranks[order], return_index=True)
        stop = [*first.tolist(), len(order)][1:]
        self.first = dict(zip(named.tolist(), zip(first.tolist(), stop)))
        self.later: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        for rank in self.first:
            self._set(rank)

    def _set(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, at: int) -> None:
        bucket = self.later.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.later[rank] = [at]
        if rank not in self.first:
            self._set(rank)

    def pop(self) -> tuple[int, np.ndarray] | None:
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        word &= word - 1
        self.low[a] = word
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        span, later = self.first.pop(rank, None), self.later.pop(rank, None)
        at = self.at[span[0] : span[1]] if span else None
        if later:
            more = np.unique(np.array(later, np.int64))
            at = more if at is None else np.union1d(at, more)
        return rank, at


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((v, k) for k, v in self.ranks.items())
        size = by_id[-1][0] + 1
        self.length = np.zeros(size, np.int64)
        for v, k in by_id:
            self.length[v] = len(k)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(k for _, k in by_id), np.uint8)
        # tiktoken's white space is the Unicode property
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # where a text holds none but these characters, the classes are plain ranges
        letters = "A-Za-zªµºÀ-ÖØ-öø-ˁ"
        digits = "0-9²³¹¼-¾"
        self.odd = re.compile("[^\t\n\r\x20-\x7e¡-ˁ]")
        self.plain_split = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t\n\r\x20{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\s", r"[\t\n\r\x20]").replace(r"\S", r"[^\t\n\r\x20]"))
        # (left id, right id) of every pair whose bytes together are a token
        pairs = {(self.ranks[k[:j]] << 32 | self.ranks[k[j:]]): v for v, k in by_id for j in range(1, len(k)) if k[:j] in self.ranks and k[j:] in self.ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.kept: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; -1: none."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[k] == key, self.pair_ranks[k], -1)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. All pieces share one queue; as no pair reaches over the end of
        a piece, and ranks rise from the lowest, each is merged as if it were alone."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return [np.zeros(0, "<u4") for _ in pieces]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        token = self.byte_ids[raw]
        last = np.cumsum(sizes) - 1
        # the next and previous token's position; n: none
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last[sizes > 0]] = n
        before[(last - sizes + 1)[sizes > 0]] = n
        waits = np.full(n + 1, -1, np.int64)  # the rank at which a position's pair waits
        alive, merging = np.ones(n, bool), np.zeros(n, bool)
        inner = np.flatnonzero(after < n)
        waits[inner] = self.rank(token[inner], token[inner + 1])
        start = np.flatnonzero(waits >= 0)
        queue = RankQueue(waits[start], start)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[waits[at] == rank]  # the others are stale
            if not len(at):
                continue
            all_at = at
            if len(at) > 1:
                tight = after[at[:-1]] == at[1:]
                if tight.any():  # of overlapping pairs, the first, third, ... merge
                    k = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~tight]), k, 0))
                    at = at[(k - head) % 2 == 0]
            mid = after[at]
            right = after[mid]
            has = right < n
            if len(at) > 1:
                # a new pair of lower rank comes before later pairs of this rank in its piece
                stop = np.zeros(len(at), bool)
                r = self.rank(np.full(int(has.sum()), rank), token[right[has]])
                stop[has] = (r >= 0) & (r < rank)
                left = before[at]
                some = left < n
                lt = token[left[some]]
                merging[mid] = True
                was = merging[left[some]]
                merging[mid] = False
                r = self.rank(np.where(was, rank, lt), np.full(len(lt), rank))
                stop[some] |= (r >= 0) & (r < rank)
                if stop.any():
                    first: dict[int, int] = {}
                    for k in np.flatnonzero(stop).tolist():
                        first.setdefault(int(piece[at[k]]), k)
                    limit = np.array([first.get(x, len(at)) for x in piece[at].tolist()])
                    wait = np.arange(len(at)) > limit
                    at, mid, right, has = at[~wait], mid[~wait], right[~wait], has[~wait]
            token[at] = rank
            alive[mid] = False
            waits[mid] = -1
            after[at] = right
            before[right[has]] = at[has]
            waits[at] = -1
            if has.any():
                k = at[has]
                waits[k] = self.rank(token[k], token[after[k]])
            left = before[at]
            left = left[left < n]
            if len(left):
                waits[left] = self.rank(token[left], token[after[left]])
                k = np.concatenate([at, left])
            else:
                k = at
            r = waits[k]
            for x, y in zip(r.tolist(), k.tolist()):
                if x >= 0:
                    queue.push(x, y)
            if len(at) < len(all_at):
                for y in all_at[waits[all_at] == rank].tolist():
                    queue.push(rank, y)
        token = token[alive].astype("<u4")
        return np.split(token, np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))[:-1])

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces, by piece. Those not too long are kept."""
        out, rest = {}, []
        for x in pieces:
            got = self.kept.get(x)
            if got is None:
                rest.append(x)
            else:
                out[x] = got
        raw = [x.encode() for x in rest]
        todo = [(x, y) for x, y in zip(rest, raw) if y not in self.ranks]
        new = {x: np.array([self.ranks[y]], "<u4").tobytes() for x, y in zip(rest, raw) if y in self.ranks}
        new |= {x: ids.tobytes() for (x, _), ids in zip(todo, self.merge([y for _, y in todo]))} if todo else {}
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
        self.kept.update((x, y) for x, y in new.items() if len(x) <= KEPT_LENGTH)
        return out | new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [(self.split if self.odd.search(x) else self.plain_split).findall(x) for x in texts]
        ids = self.learn(set().union(*split))
        return [np.frombuffer(b"".join([ids[p] for p in x]), "<u4") for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.length[ids]
        at = np.repeat(self.offset[ids] - (np.cumsum(n) - n), n)
        return self.bytes[at + np.arange(len(at))].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """One row per document: id, ids (array<int>; if with_ids), n_tokens, ids_sha256,
    decoded_sha256 (of the bytes decoded from the ids). Nothing is shuffled. path: a rank file
    that every executor can open."""
    tuned(docs.sparkSession)
    path = path or public_tokenizers.path(RANK_FILE)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in batches:
            data, offs = column_bytes(b.column(1))
            for lo, hi in row_chunks(offs, BLOCK_BYTES):
                ids = codec.encode([data[offs[k] : offs[k + 1]].tobytes().decode() for k in range(lo, hi)])
                cols = [b.column(0).slice(lo, hi - lo)]
                if with_ids:
                    at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))))
                cols += [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays(cols, ["id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(lean(scan), f"id {dict(source.dtypes)['id']}, {'ids array<int>, ' * with_ids}n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The texts of rows of ids (null ids: empty): id, text."""
    tuned(encoded.sparkSession)
    path = path or public_tokenizers.path(RANK_FILE)
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in batches:
            texts = [codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(scan, f"id {dict(source.dtypes)['id']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document encoded and decoded."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).withColumnRenamed("id", "doc_id")
