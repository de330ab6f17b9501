"""A quality classifier over random-indexing word vectors.

Each word has a sparse random index vector of -1, 0 and 1; over the whole corpus, a word's context
vector sums the index vectors of the words before and after it, and of its occurrences' shapes (letter
cases, digits, marks; whether it repeats the word before). A word's vector is the sign of each number
of its context vector, 0 for those below half of their root mean square. Shapes have context vectors
like words, of unit length in 127ths. A document is the mean of its words' and of its shapes' vectors. On these a
network of two layers is trained in numpy, and the temperature of its probabilities is set on labelled
rows kept apart.

Every word, told by the bits of its bucket and 48 more, has a vector of its own. Each task sends its
words' sums packed by bucket of words; a bucket adds them up and is a row of a table in the shared
folder. The commonest words, KNOWN_WORDS at most, are broadcast; for all others a batch of documents asks
the buckets and meets the answers. No vocabulary is gathered anywhere, and how many words are broadcast
changes no score, as all sums over words are of whole numbers.

Labels are taken from a sample of bounded, stated size; the context vectors come from all
documents. Labels, language, source and id are never inputs of a score.

Cases: null and empty texts have a vector of zeros and the score that goes with it; rows with the
same text have the same score; of several labels of one id the largest counts; without any usable
label every score is 0.5; words that the model has never seen have a vector of zeros; input columns
of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textcore import NOT_SPACE, Words, batch_numbers, bucket_bits, column_bytes, lean, mix, packed_numbers, row_chunks, segment, stored, tuned, unpacked_numbers

#: Dimensions of word vectors.
DIM = 32
#: Shapes of words.
SHAPES = 256
#: Words of text for a bucket, about.
BUCKET_WORDS = 1_000_000
#: Words whose sums a task holds before it sends them, about.
HELD_WORDS = 400_000
#: Words whose sums are added up at once.
MERGED = 1 << 15
#: Bytes of documents that ask for their words' vectors together.
BATCH_BYTES = 4 << 20
#: Bytes of a hash that travel beside its bucket.
SENT = 6
#: Words whose vectors are broadcast, at most.
KNOWN_WORDS = 500_000
#: Non-zero places of an index vector.
PLACES = 2
#: Labelled rows that the network learns from, at most.
SAMPLE_ROWS = 20_000
#: Units of the hidden layer, rounds over the sample, and the learning rate.
HIDDEN, ROUNDS, RATE = 48, 60, 0.004

_KINDS = np.full(256, 3, np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 0


def shapes_of(raw: np.ndarray, w: Words) -> np.ndarray:
    """The shape of each word: the kinds of its first, second and last byte, whether its last byte
    is a mark that is doubled, and whether it repeats the word before. Bytes of other scripts
    count as small letters."""
    a, z = w.start, w.end - 1
    second = np.minimum(a + 1, z)
    doubled = (raw[z] == raw[np.maximum(z - 1, a)]) & (_KINDS[raw[z]] == 3) & (z > a)
    again = np.zeros(len(a), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    return (_KINDS[raw[a]] * 16 + _KINDS[raw[second]] * 4 + _KINDS[raw[z]]) + 64 * doubled + 128 * again


_shape_keys = mix(np.arange(SHAPES, dtype=np.uint64) + np.uint64(77))
_shape_order = np.argsort(_shape_keys)


def _chunks(col: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words, distinct hashes of words, each word's place in them, its shape)."""
    data, offs = column_bytes(col)
    for lo, hi in row_chunks(offs):
        o, raw = offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        w = segment(raw, o, NOT_SPACE)
        keys, at = np.unique(w.hash, return_inverse=True)
        yield lo, hi, w, keys, at, shapes_of(raw, w) if len(at) else at


def _index_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero places of each key's index vector, and their signs."""
    part = np.stack([keys >> np.uint64(8 + 20 * k) for k in range(PLACES)], axis=1)
    return (part % np.uint64(DIM)).astype(np.int64), np.where((part >> np.uint64(10)) & np.uint64(1), 1.0, -1.0)


_shape_places = _index_places(_shape_keys)


def gather(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of a column, the distinct keys of words and shapes, which rise, and what the texts add to
    their context vectors; behind these stands how often each key occurs."""
    for _, _, w, keys, slot, shape in _chunks(col):
        n = len(keys)
        near = w.row[1:] == w.row[:-1]
        before, after = np.flatnonzero(near), np.flatnonzero(near) + 1
        places, signs = _index_places(keys)
        # (rows that gain, places and signs of what they gain); shapes' rows follow the words'
        pairs = ((slot[after], slot[before], places, signs), (slot[before], slot[after], places, signs), (slot, shape, *_shape_places), (n + shape, shape, *_shape_places), (n + shape[after], shape[before], *_shape_places))
        width = DIM + 1
        at = [(to[:, None] * width + p[of]).ravel() for to, of, p, _ in pairs] + [slot * width + DIM, (n + shape) * width + DIM]
        gain = [s[of].ravel() for _, of, _, s in pairs] + [np.ones(2 * len(slot))]
        total = np.bincount(np.concatenate(at), np.concatenate(gain), (n + SHAPES) * width).reshape(-1, width).astype(np.int32)
        both = np.concatenate([keys, _shape_keys])
        used = np.flatnonzero(total[:, DIM])
        order = used[np.argsort(both[used], kind="stable")]
        yield both[order], total[order]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums by key, added up, in parts of MERGED keys at most; the keys rise."""
    if not sum(len(k) for k, _ in parts):
        return
    keys, sums = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for k in range(0, len(first), MERGED):
        at = first[k : k + MERGED]
        end = first[k + MERGED] if k + MERGED < len(first) else len(keys)
        yield keys[at], np.add.reduceat(sums[order[at[0] : end]].astype(np.int64), at - at[0], axis=0)


class Held:
    """Sums by key that grow part by part; rows of small numbers take a byte a number."""

    def __init__(self) -> None:
        self.small: list[tuple[np.ndarray, np.ndarray]] = []
        self.large: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def _add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        wide = (sums.max(1) > 127) | (sums.min(1) < -127)
        self.small.append((keys[~wide], sums[~wide].astype(np.int8)))
        self.large.append((keys[wide], sums[wide].astype(np.int64)))
        self.size += len(keys)

    def add(self, keys: np.ndarray, sums: np.ndarray) -> bool:
        """Whether there are so many keys now that they should be sent."""
        self._add(keys, sums)
        if self.size <= 2 * self.merged + HELD_WORDS // 4:
            return False
        small, self.small, self.size = self.small, [], 0
        for part in _merged(small):
            self._add(*part)
        self.large = list(_merged(self.large))
        self.size = self.merged = sum(len(k) for k, _ in self.small + self.large)
        return self.size > HELD_WORDS

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys, which rise, with their sums, to be added up with those of other tasks."""
        yield from _merged(self.small)
        yield from _merged(self.large)


def _packed(x: np.ndarray) -> bytes:
    """Rows of whole numbers, most of them 0 or small: bytes, column by column, and the large ones apart."""
    large = np.abs(x) > 127
    at = np.flatnonzero(large)
    raw = np.array([*x.shape, len(at)], "<u8").tobytes() + np.ascontiguousarray(np.where(large, 0, x).astype(np.int8).T).tobytes() + at.astype("<u8").tobytes() + x[large].astype("<i8").tobytes()
    return zstandard.compress(raw, 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n, width, k = np.frombuffer(raw, "<u8", 3).tolist()
    out = np.frombuffer(raw, np.int8, n * width, 24).reshape(width, n).T.astype(np.int64, order="C")
    out.ravel()[np.frombuffer(raw, "<u8", k, 24 + n * width).astype(np.int64)] = np.frombuffer(raw, "<i8", k, 24 + n * width + 8 * k)
    return out


def codes_of(sums: np.ndarray) -> np.ndarray:
    """Context vectors to words' vectors, two bits a number: whether it is not 0, whether it is below."""
    x = sums.astype(float)
    on = (x != 0) & (4 * DIM * x * x >= (x * x).sum(1, keepdims=True))
    return np.concatenate([np.packbits(on, axis=1), np.packbits(x < 0, axis=1)], axis=1)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """Words' vectors of -1, 0 and 1."""
    on, below = np.unpackbits(codes[:, : DIM // 8], axis=1), np.unpackbits(codes[:, DIM // 8 :], axis=1)
    return on.astype(np.int8) * (1 - 2 * below.astype(np.int8))


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Of rising keys, the part for each bucket that has some."""
    named, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return [(int(k), slice(a, z)) for k, a, z in zip(named.tolist(), first.tolist(), [*first.tolist(), len(keys)][1:])]


def _short(keys: np.ndarray, bits: int) -> bytes:
    """The bytes of keys that travel; their bucket stands for the rest."""
    return ((keys << np.uint64(bits)) >> np.uint64(64 - 8 * SENT)).view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _widened(blob: bytes) -> np.ndarray:
    """Such bytes as numbers, in the order of the keys."""
    wide = np.zeros((len(blob) // SENT, 8), np.uint8)
    wide[:, :SENT] = np.frombuffer(blob, np.uint8).reshape(-1, SENT)
    return wide.view("<u8").ravel()


def _level(n: np.ndarray) -> np.ndarray:
    """A number from 0 to 255 that rises with how often a word occurs."""
    return np.minimum(np.floor(4 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)


TABLE = "bucket int, keys binary, codes binary, levels binary, shapes binary"


def _adder(bits: int):
    """One bucket: each of its words once with its vector, and the sums of its shapes."""
    marks = {int(x): k for k, x in enumerate((_shape_keys << np.uint64(bits)) >> np.uint64(64 - 8 * SENT))}
    home = (_shape_keys >> np.uint64(64 - bits)).astype(np.int64)

    def add_up(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        parts = list(_merged([(_widened(k), _unpacked(x)) for k, x in zip(table["keys"].to_pylist(), table["sums"].to_pylist())]))
        keys, sums = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
        shapes = [(marks[k], i) for i, k in enumerate(keys.tolist()) if k in marks and home[marks[k]] == bucket]
        rows = np.array([[k, *sums[i, :DIM]] for k, i in shapes], "<i8").reshape(-1, DIM + 1)
        kept = np.ones(len(keys), bool)
        kept[[i for _, i in shapes]] = False
        keys, sums = keys[kept], sums[kept]
        blobs = [np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes(), codes_of(sums[:, :DIM]).tobytes(), _level(sums[:, DIM]).tobytes(), rows.tobytes()]
        return pa.table([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["bucket", "keys", "codes", "levels", "shapes"])

    return add_up


@dataclass
class WordVectors:
    """The table of all words' vectors, a row for each bucket; the bits of a bucket's number; the
    commonest words' keys, which rise, with their codes; the shapes' vectors. Keys are told by
    the bits that travel."""

    table: DataFrame
    bits: int
    known: np.ndarray
    codes: np.ndarray
    shapes: np.ndarray


def context_vectors(docs: DataFrame, text_col: str = "text", known_words: int = KNOWN_WORDS) -> WordVectors:
    """The vectors of all documents' words and shapes."""
    spark = docs.sparkSession
    tuned(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    bits = bucket_bits(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_WORDS)

    def sent(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        cuts = _cuts(keys, bits)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cuts], pa.int32()), pa.array([_short(keys[z], bits) for _, z in cuts], pa.binary()), pa.array([_packed(sums[z]) for _, z in cuts], pa.binary())], ["bucket", "keys", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            for keys, sums in gather(b.column(0)):
                if held.add(keys, sums):
                    yield from (sent(*x) for x in held.parts())
                    held = Held()
        yield from (sent(*x) for x in held.parts())

    sums = texts.mapInArrow(lean(part), "bucket int, keys binary, sums binary").groupBy("bucket").applyInArrow(lean(_adder(bits)), TABLE)
    table = stored(sums, "vectors")

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["level", "n"])

    counts = np.zeros(256, np.int64)
    for r in table.select("levels").mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    # the lowest level from which on the words are few enough
    above = np.cumsum(counts[::-1])[::-1]
    least = int(np.argmax(above <= known_words)) if (above <= known_words).any() else 256

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, keys, codes, lv in zip(*(b.column(k).to_pylist() for k in range(4))):
                on = np.frombuffer(lv, np.uint8) >= least
                if on.any():
                    k = _widened(keys)[on] << np.uint64(64 - 8 * SENT) >> np.uint64(bits) | np.uint64(bucket) << np.uint64(64 - bits)
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([np.frombuffer(codes, np.uint8).reshape(-1, DIM // 4)[on].tobytes()], pa.binary())], ["keys", "codes"])

    # known_words rows of 16 bytes at most
    rows = table.select("bucket", "keys", "codes", "levels").mapInArrow(common, "keys binary, codes binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64)
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), np.uint8).reshape(-1, DIM // 4)
    order = np.argsort(keys)
    shapes = np.zeros((SHAPES, DIM))
    for r in table.where(F.octet_length("shapes") > 0).select("shapes").collect():
        for row in np.frombuffer(r["shapes"], "<i8").reshape(-1, DIM + 1):
            shapes[row[0]] = row[1:]
    shapes = np.round(127 * shapes / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-9)).astype(np.int32)
    return WordVectors(table, bits, keys[order], codes[order], shapes)


def _sized(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about BATCH_BYTES of text, or of one longer row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        _, offs = column_bytes(b.column(text_at))
        for lo, hi in row_chunks(offs, BATCH_BYTES):
            held.append(b.slice(lo, hi - lo))
            size += int(offs[hi] - offs[lo])
            if size >= BATCH_BYTES // 2:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rows_sum(x: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
    """Adds x's rows up in runs of count rows, to the rows of out."""
    full = np.flatnonzero(count)
    if len(full):
        out[full] += np.add.reduceat(x, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)


def with_vectors(docs: DataFrame, text_at: int, kept: list[int], words: WordVectors, use: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | StructType) -> DataFrame:
    """What ``use`` makes of each batch of documents, of which it gets the columns ``kept``, and of
    the rows of features() for their texts."""
    bits = words.bits
    unsent = np.uint64(max(0, 64 - 8 * SENT - bits))
    shared = docs.sparkSession.sparkContext.broadcast((words.known, words.codes, words.shapes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, shapes = shared.value
        vectors = vectors_of(codes)
        for batch, b in zip(batch_numbers(), _sized(batches, text_at)):
            own = np.zeros((2, b.num_rows, DIM), np.int32)
            size, rare, row = np.zeros(b.num_rows, np.int64), [], []
            for lo, hi, w, keys, slot, shape in _chunks(b.column(text_at)):
                n = w.counts
                size[lo:hi] = n
                if not len(slot):
                    continue
                sent = keys >> unsent << unsent
                at = np.minimum(np.searchsorted(known, sent), max(len(known) - 1, 0))
                has = known[at] == sent if len(known) else np.zeros(len(keys), bool)
                mine = np.zeros((len(keys), DIM), np.int8)
                mine[has] = vectors[at[has]]
                _rows_sum(mine[slot], n, own[0, lo:hi])
                _rows_sum(shapes[shape], n, own[1, lo:hi])
                lacks = ~has[slot]
                rare.append(w.hash[lacks])
                row.append(w.row[lacks] + lo)
            asked, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *rare]), return_inverse=True)
            row = np.concatenate([np.zeros(0, np.int64), *row])
            order = np.lexsort((at, row))
            cuts = _cuts(asked, bits)
            payload = pa.BufferOutputStream()
            part = b.select(kept)
            with pa.ipc.new_stream(payload, part.schema) as writer:
                writer.write_batch(part)
            parts = [payload.getvalue().to_pybytes(), packed_numbers(size, np.bincount(row, minlength=b.num_rows), at[order], own.view(np.uint32).ravel()), np.array([len(cuts), len(asked)], "<u8").tobytes()]
            blob = zstandard.compress(np.array([len(x) for x in parts], "<u8").tobytes() + b"".join(parts), 3)
            home = int(mix(np.array([batch], np.uint64))[0] >> np.uint64(64 - bits))
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array([home, *(k for k, _ in cuts)], pa.int32()), pa.array([batch] * (n + 1), pa.int64()), pa.array([None, *(_short(asked[z], bits) for _, z in cuts)], pa.binary()), pa.array([blob, *[None] * n], pa.binary())], ["bucket", "batch", "asked", "own"])

    def answer(sent: pa.Table, table: pa.Table) -> pa.Table:
        named, codes = np.zeros(0, np.uint64), np.zeros((0, DIM // 4), np.uint8)
        if table.num_rows:
            named, codes = _widened(table["keys"][0].as_py()), np.frombuffer(table["codes"][0].as_py(), np.uint8).reshape(-1, DIM // 4)
        told = []
        for x in sent["asked"].to_pylist():
            if x is None:
                told.append(None)
                continue
            keys = _widened(x)
            out = np.zeros((len(keys), DIM // 4), np.uint8)
            if len(named):
                at = np.minimum(np.searchsorted(named, keys), len(named) - 1)
                same = named[at] == keys
                out[same] = codes[at[same]]
            told.append(out.tobytes())
        return pa.table([sent["batch"], sent["bucket"], pa.array(told, pa.binary()), sent["own"]], ["batch", "of", "told", "own"])

    def meet(table: pa.Table) -> pa.Table:
        own, told = table.filter(pc.is_valid(table["own"])), table.filter(pc.is_null(table["own"])).sort_by("of")
        raw = zstandard.decompress(own["own"][0].as_py())
        sizes = np.frombuffer(raw, "<u8", 3).tolist()
        payload, numbers, expected = (raw[a : a + n] for a, n in zip((24, 24 + sizes[0], 24 + sizes[0] + sizes[1]), sizes))
        rows = pa.ipc.open_stream(payload).read_all()
        size, n_rare, at, sums = unpacked_numbers(numbers, 4)
        sums = np.ascontiguousarray(sums, "<u4").view(np.int32).reshape(2, rows.num_rows, DIM).copy()
        codes = np.frombuffer(b"".join(told["told"].to_pylist()), np.uint8).reshape(-1, DIM // 4)
        if [told.num_rows, len(codes)] != np.frombuffer(expected, "<u8").tolist():
            raise RuntimeError("the rows of a batch came in another order when it was read again")
        if len(at):
            _rows_sum(vectors_of(codes)[at.astype(np.int64)], n_rare.astype(np.int64), sums[0])
        return use(rows, features(sums, size.astype(np.int64)))

    sent = docs.mapInArrow(lean(ask), "bucket int, batch long, asked binary, own binary")
    back = sent.groupBy("bucket").cogroup(words.table.select("bucket", "keys", "codes").groupBy("bucket")).applyInArrow(lean(answer), "batch long, of int, told binary, own binary")
    return back.groupBy("batch").applyInArrow(lean(meet), schema)


def features(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of 2 x DIM + 2 numbers for each text, by the sums of its words' and shapes' vectors."""
    words, marks = sums[0] / np.maximum(size, 1)[:, None], sums[1] / (127 * np.maximum(size, 1)[:, None])
    return np.concatenate([words, marks, np.linalg.norm(words, axis=1, keepdims=True), np.linalg.norm(marks, axis=1, keepdims=True)], axis=1).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x.astype(float)) / self.temperature)


@dataclass
class Model:
    """The words' vectors and the network."""

    words: WordVectors
    network: Network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit the network on nine tenths of the rows, the temperature on the rest."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * DIM + 2), np.ones(2 * DIM + 2))
    rng = np.random.default_rng(11)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = Network(mean, scale, p[0], p[1], p[2], 0.0, 1.0)
    if len(y) < 20 or y.min() == y.max():
        model.w2 = np.zeros(HIDDEN)
        return model
    z = (x - mean) / scale
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 10], order[len(y) // 10 :]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for r in range(ROUNDS):
        rng.shuffle(learn)
        for k in range(0, len(learn), 256):
            i = learn[k : k + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (_sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
            back = e[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            t += 1
            for a, g, mm, vv in zip(p, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= RATE * (1 - r / ROUNDS) * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    logit = model.logits(x[held])
    loss = lambda s: -np.mean(y[held] * np.log(_sigmoid(logit / s) + 1e-12) + (1 - y[held]) * np.log(1 - _sigmoid(logit / s) + 1e-12))
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fold(id_col: str | Column = "doc_id") -> Column:
    """The fold of a row: rows in fold 1 are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(0)) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from all texts and at most ``sample`` labelled rows, the first by a hash of their id."""
    tuned(docs.sparkSession)
    words = context_vectors(docs, text_col)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 1)).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("double").alias("y"))
    wanted = {r["id"]: r["y"] for r in usable.orderBy(F.xxhash64("id"), "id", "y").limit(sample).collect()}
    # a broadcast of ``sample`` rows at most
    told = docs.sparkSession.createDataFrame(list(wanted.items()), "id string, y double")

    def use(rows: pa.Table, x: np.ndarray) -> pa.Table:
        return pa.table([rows["id"], rows["y"], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    # repeated ids: the first by id and vector, so that the sample keeps its bound
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(told), "id").select("id", "y", "text")
    rows = with_vectors(texts, 2, [0, 1], words, use, "id string, y double, x binary").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float).reshape(len(rows), 2 * DIM + 2)
    return Model(words, train(x, np.array([r["y"] for r in rows])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    network = model.network
    use = lambda rows, x: pa.table([rows.column(0), pa.array(network.scores(x))], ["id", "score"])
    return with_vectors(source, 1, [0], model.words, use, f"id {dict(source.dtypes)['id']}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents of at least this score, with their own columns."""
    tuned(docs.sparkSession)
    network = model.network
    return with_vectors(docs, docs.columns.index(text_col), list(range(len(docs.columns))), model.words, lambda rows, x: rows.filter(pa.array(network.scores(x) >= least)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
