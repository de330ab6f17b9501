"""Vectorised word segmentation and hashing over Arrow string columns.

Text stays in Arrow's UTF-8 buffer. Both word classes used by the operators treat every byte of
a code point above 0x7F alike, so segmentation by bytes equals segmentation by code points.
"""

from __future__ import annotations

import atexit
import ctypes
import inspect
import math
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard

from ..storage import stored as stored

#: Bytes of text handled at once; a longer row is handled alone.
CHUNK_BYTES = 1 << 18
#: Documents in one Arrow batch.
ARROW_ROWS = 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]`` in bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in bytes, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_KEYS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
#: Odd multipliers, one for each word of an n-gram.
GRAM_KEYS = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


_shipped: set[str] = set()


def ship(spark) -> None:
    """Hand this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    own = tempfile.mkdtemp()  # on the driver, whose file server hands it out while the application lives
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    name = Path(own) / f"sparloom_{context.applicationId}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)


def tuned(spark) -> None:
    """Bound what one Arrow batch holds, so that long rows don't fill a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(k))])) for k in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def release() -> None:
    """Give the memory that a Python worker has freed back to the machine; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function: Callable) -> Callable:
    """The function for mapInArrow or applyInArrow, followed by release()."""

    def rest(out):
        yield from out
        release()

    def given(out):
        if not isinstance(out, pa.Table):
            return rest(out)
        release()
        return out

    # Spark counts the arguments
    if sum(p.default is p.empty for p in inspect.signature(function).parameters.values()) == 2:
        return lambda a, b: given(function(a, b))
    return lambda a: given(function(a))


def batch_numbers() -> Iterator[int]:
    """A number for each batch of a task, that no other batch of the stage has and a rerun repeats."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def bucket_bits(total_bytes: int, per_bucket: int) -> int:
    """Bits of a bucket's number: as many buckets as hold about per_bucket of the texts' words."""
    return min(30, max(8, math.ceil(math.log2(max(1.0, total_bytes / 6 / per_bucket)))))


def packed_numbers(*parts: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, byte plane by byte plane, compressed."""
    wide = [8 if len(p) and p.max() >= 2**32 else 4 for p in parts]
    raw = b"".join(np.ascontiguousarray(p.astype(f"<u{n}").view(np.uint8).reshape(-1, n).T).tobytes() for p, n in zip(parts, wide))
    return np.array([[len(p), n] for p, n in zip(parts, wide)], "<u4").tobytes() + zstandard.compress(raw, 1)


def unpacked_numbers(blob: bytes, n: int) -> list[np.ndarray]:
    """The n arrays of such a blob; of 64 bits where numbers need them, else of 32."""
    sizes = np.frombuffer(blob, "<u4", 2 * n).reshape(n, 2).tolist()
    total = sum(k * width for k, width in sizes)
    raw = np.frombuffer(zstandard.decompress(blob[8 * n :], max_output_size=total), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for k, width in sizes:
        out.append(np.ascontiguousarray(raw[at : at + width * k].reshape(width, k).T).view(f"<u{width}").ravel())
        at += width * k
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its int64 row offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


@dataclass
class Words:
    """The words of some rows: byte ranges in ``data`` (lower-cased), their row and 64-bit hash."""

    data: np.ndarray
    n_rows: int
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    @property
    def first(self) -> np.ndarray:
        """The index of each row's first word, and the number of all words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1, joined by a space."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(lo, hi))

    def grams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words inside a row. short: a row
        with fewer words, but not none, gives one gram of them all."""
        w, row = self.hash, self.row
        with np.errstate(over="ignore"):
            at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h += w[at + j] * GRAM_KEYS[j]
            h = mix(h)
            if short and n > 1:
                c, first = self.counts, self.first
                few = np.flatnonzero((c > 0) & (c < n))
                if len(few):
                    h2 = GRAM_KEYS[15] * c[few].astype(np.uint64)
                    for j in range(n - 1):
                        has = c[few] > j
                        h2[has] += w[first[few[has]] + j] * GRAM_KEYS[j]
                    at, h = np.concatenate([at, first[few]]), np.concatenate([h, mix(h2)])
                    order = np.argsort(at, kind="stable")
                    at, h = at[order], h[order]
        return at, h


def segment(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Words of the rows whose bytes are data[offs[k]:offs[k+1]]; kind: a table of word bytes."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, len(offs) - 1, z, z, z, np.zeros(0, np.uint64))
    m = kind[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    s[heads] = m[heads]
    e[tails] = m[tails]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    row = np.searchsorted(offs[1:], start, "right")
    up, down = _tables(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[data] * up[:n])])
        h = mix((total[end] - total[start]) * down[start])
    return Words(data, len(offs) - 1, start, end, row, h)


def word_chunks(col: pa.Array, kind: np.ndarray, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive groups of rows of a string column."""
    data, offs = column_bytes(col)
    for lo, hi in row_chunks(offs, limit):
        o = offs[lo : hi + 1]
        yield lo, hi, segment(data[o[0] : o[-1]], o - o[0], kind, lower)


def plain_words(text: str | None, pattern: str) -> list[str]:
    """The same words by the regular expression itself; for checks."""
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


#: The word patterns that ALNUM and NOT_SPACE stand for.
ALNUM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE_PATTERN = r"[^\x20\x09-\x0D]+"
