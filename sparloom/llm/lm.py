"""Language-model scores by deleted interpolation.

The probability of a word after the word before it mixes the maximum-likelihood estimates of the
pair and of the word alone with a uniform share. The mixture's weights depend on a bucket of the
context's frequency and are learned by expectation-maximisation on the counts of a held-out part
of the training documents, against the counts of the rest. Scores then use the counts of all
training documents.

How it runs: each Arrow batch of texts is coded with a vocabulary of its own, commonest words
first. Its distinct words and pairs travel as hashes, packed by bucket, with their counts; a
bucket adds the counts of all batches up and sends each batch the totals of what it asked for.
Batches meet their totals once and are written to the shared folder; learning the weights and
scoring are passes over that table. No vocabulary is gathered anywhere.

Cases: null and empty texts have the end as their only token; rows with equal ids are separate
documents of the same fold; a null id counts as crc32 0. Without training tokens every weight is
on the uniform share. Input columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import GRAM_KEYS, NOT_SPACE, batch_numbers, bucket_bits, column_bytes, lean, mix, packed_numbers, row_chunks, segment, stored, tuned, unpacked_numbers

#: Context-frequency buckets: 0, 1, 2-3, 4-7, ... documents' occurrences.
CONTEXTS = 20
#: Cells for one doubling of an estimate, when held-out events are added up for learning.
FINENESS = 8
#: Rounds of expectation-maximisation.
ROUNDS = 60
#: Bytes of a hash that travel beside its bucket.
SENT = 6
#: Distinct words and pairs in a bucket, about.
BUCKET_KEYS = 2_000_000
#: The end of a text, as a word's hash.
END = np.uint64(0x1F3D5B79A2C4E6F8)


def fold(c: Column) -> Column:
    """The checksum that a row's part hangs on."""
    return F.coalesce(F.crc32(c.cast("string")), F.lit(0))


def _buckets(marks: np.ndarray, words: np.ndarray, before: np.ndarray | None, bits: int) -> np.ndarray:
    """Bucket numbers of words, or of pairs, from the 16-bit marks of their words."""
    h = marks[words].astype(np.uint64) + np.uint64(1 << 40)
    if before is not None:
        h = h + (marks[before].astype(np.uint64) << np.uint64(16)) + np.uint64(1 << 41)
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _before(words: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The word before each; before a text's first word stands the end."""
    out = np.empty(len(words), np.int64)
    out[1:] = words[:-1]
    out[(np.cumsum(lengths) - lengths)] = end
    return out


def _sender(bits: int):
    """Texts to (bucket, batch, ids, blob, tokens): a row for the batch itself, and one for each bucket."""

    def coded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all tokens, and the number of each row's."""
        data, offs = column_bytes(col)
        parts, lengths = [], []
        for lo, hi in row_chunks(offs):
            w = segment(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], NOT_SPACE)
            n = w.counts
            parts.append(np.insert(w.hash, np.cumsum(n), END))
            lengths.append(n + 1)
        return np.concatenate(parts), np.concatenate(lengths)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in zip(batch_numbers(), batches):
            if not b.num_rows:
                continue
            token, lengths = coded(b.column(2))
            part = np.array(b.column(1).to_pylist(), np.int64)  # 0: held out, 1: training, 2: training, for the weights
            of = np.repeat(part, lengths)
            learn, weigh = (of > 0).astype(np.int64), (of == 2).astype(np.int64)
            named, inverse, n = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            word, named = rank[inverse], named[order]
            end = int(np.flatnonzero(named == END)[0])
            marks = (named >> np.uint64(48)).astype(np.int64)  # the bits that don't travel
            before = _before(word, lengths, end)
            pairs, pair = np.unique(before * len(named) + word, return_inverse=True)
            with np.errstate(over="ignore"):
                pair_hash = mix(named[pairs // len(named)] * GRAM_KEYS[0] + named[pairs % len(named)] * GRAM_KEYS[1])
            add = lambda at, weight, k: np.bincount(at, weight, k).astype(np.int64)
            sides = []
            for keys, at, where in ((named, word, _buckets(marks, np.arange(len(named)), None, bits)), (pair_hash, pair, _buckets(marks, pairs % len(named), pairs // len(named), bits))):
                order = np.argsort(where, kind="stable")
                where = where[order]
                body = (keys[order] & np.uint64(2**48 - 1)).view(np.uint8).reshape(-1, 8)[:, :SENT]
                cuts = np.searchsorted(where, np.arange((1 << bits) + 1))
                sides.append((where, body, add(at, learn, len(keys))[order], add(at, weigh, len(keys))[order], cuts))
            used = np.union1d(sides[0][0], sides[1][0]).tolist()
            blobs = []
            for k in used:
                z = [slice(c[k], c[k + 1]) for _, _, _, _, c in sides]
                counts = packed_numbers(*[s[j][q] for s, q in zip(sides, z) for j in (2, 3)])
                keys = b"".join(s[1][q].tobytes() for s, q in zip(sides, z))
                blobs.append(np.array([len(counts)], "<u4").tobytes() + counts + keys)
            own = packed_numbers(word, marks, lengths, part, np.array([end]))
            rows = len(blobs) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(mix(np.array([batch], np.uint64))[0] >> np.uint64(64 - bits)), *used], pa.int32()), pa.array([batch] * rows, pa.int64()), pa.array([b.column(0).to_pylist(), *[None] * len(blobs)], pa.list_(b.column(0).type)), pa.array([own, *blobs], pa.binary()), pa.array([int(learn.sum()), *[0] * len(blobs)], pa.int64()), pa.array([int(weigh.sum()), *[0] * len(blobs)], pa.int64())],
                ["bucket", "batch", "ids", "blob", "learn", "weigh"],
            )

    return scan


def _count(table: pa.Table) -> pa.Table:
    """One bucket: adds counts up and sends each batch the totals of its words and pairs."""
    told, sent = table.filter(pc.is_valid(table["ids"])), table.filter(pc.is_null(table["ids"]))
    columns = [told[c].to_pylist() for c in ("batch", "ids", "blob", "learn", "weigh")] + [[0] * told.num_rows, [None] * told.num_rows]
    keys, counts, sizes = ([], []), ([], []), []
    for blob in sent["blob"].to_pylist():
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        parts = unpacked_numbers(blob[4 : 4 + n], 4)
        body = np.frombuffer(blob, np.uint8, -1, 4 + n).reshape(-1, SENT)
        wide = np.zeros((len(body), 8), np.uint8)
        wide[:, :SENT] = body
        h = wide.view("<u8").ravel()
        cut = len(parts[0])
        for side, part in ((0, h[:cut]), (1, h[cut:])):
            keys[side].append(part)
            counts[side].append(parts[2 * side : 2 * side + 2])
        sizes.append((cut, len(h) - cut))
    if sizes:
        back, known = [], 0
        for side in (0, 1):
            _, inverse = np.unique(np.concatenate(keys[side]), return_inverse=True)
            totals = [np.bincount(inverse, np.concatenate([c[j] for c in counts[side]])).astype(np.int64) if len(inverse) else np.zeros(0, np.int64) for j in (0, 1)]
            if side == 0:
                known = int((totals[0] > 0).sum())
            back.append([t[inverse] if len(inverse) else t for t in totals])
        at = [0, 0]
        for k, batch in enumerate(sent["batch"].to_pylist()):
            parts = []
            for side in (0, 1):
                z = slice(at[side], at[side] + sizes[k][side])
                parts += [back[side][j][z] for j in (0, 1)]
                at[side] = z.stop
            for c, v in zip(columns, (batch, None, packed_numbers(*parts), 0, 0, known if k == 0 else 0, sent["bucket"][k].as_py())):
                c.append(v)
    kinds = [pa.int64(), table.schema.field("ids").type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "ids", "blob", "learn", "weigh", "known", "of"])


def _meet(table: pa.Table) -> pa.Table:
    """One batch with all its totals, as one row."""
    told, back = table.filter(pc.is_valid(table["ids"])).slice(0, 1), table.filter(pc.is_null(table["ids"]))
    total = lambda t, c: int(pc.sum(t[c]).as_py() or 0)
    kinds = [table.schema.field("ids").type, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64()]
    row = [told["ids"][0].as_py() if told.num_rows else [], told["blob"][0].as_py() if told.num_rows else b"", back["of"].to_pylist(), back["blob"].to_pylist(), total(told, "learn"), total(told, "weigh"), total(back, "known")]
    return pa.table([pa.array([c], k) for c, k in zip(row, kinds)], ["ids", "own", "buckets", "blobs", "learn", "weigh", "known"])


def _events(own: bytes, buckets: list[int], blobs: list[bytes], bits: int) -> tuple[np.ndarray, ...]:
    """Of every token of a batch: the counts, with all training texts and with those for the
    weights only, of the word, its context and the pair; and the rows' lengths and parts."""
    word, marks, lengths, part, end = unpacked_numbers(own, 5)
    word, marks, lengths = word.astype(np.int64), marks.astype(np.int64), lengths.astype(np.int64)
    before = _before(word, lengths, int(end[0]))
    pairs, pair = np.unique(before * len(marks) + word, return_inverse=True)
    wheres = (_buckets(marks, np.arange(len(marks)), None, bits), _buckets(marks, pairs % len(marks), pairs // len(marks), bits))
    orders = [np.argsort(w, kind="stable") for w in wheres]
    wheres = [w[o] for w, o in zip(wheres, orders)]
    totals = [[np.zeros(len(w), np.int64) for _ in (0, 1)] for w in wheres]
    for k, blob in zip(buckets, blobs):
        parts = unpacked_numbers(blob, 4)
        for side in (0, 1):
            a, z = np.searchsorted(wheres[side], [k, k + 1])
            for j in (0, 1):
                totals[side][j][orders[side][a:z]] = parts[2 * side + j]
    (w, ww), (p, pw) = totals
    return (w[word], ww[word]), (w[before], ww[before]), (p[pair], pw[pair]), lengths, part


def context_bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1.0)), CONTEXTS - 1).astype(np.int64)


def _levels(f: np.ndarray) -> np.ndarray:
    """The cell of an estimate: -1 for zero, else steps below 1."""
    return np.where(f > 0, np.round(-np.log2(np.maximum(f, 1e-300)) * FINENESS), -1).astype(np.int64)


def learn_weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights of (pair, word, uniform) by context bucket; cells: rows of bucket, pair level, word level, events."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    value = lambda x: np.where(x < 0, 0.0, 2.0 ** (-x / FINENESS))
    at, n = cells[:, 0].astype(np.int64), cells[:, 3].astype(float)
    f = np.stack([value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), 1.0 / (vocabulary + 1))], axis=1)
    for _ in range(ROUNDS):
        share = weights[at] * f
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(at, share[:, k], CONTEXTS) for k in range(3)], axis=1) + [1e-6, 1e-6, 1e-3]
        weights = total / total.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, weight_every: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document. Rows whose
    checksum modulo ``folds`` is ``held_fold`` are not learned from; of the others one in
    ``weight_every`` teaches the weights."""
    spark = docs.sparkSession
    tuned(spark)
    check = fold(F.col(id_col))
    part = F.when(check % folds == held_fold, 0).when(F.floor(check / folds) % weight_every == 0, 2).otherwise(1)
    source = docs.select(F.col(id_col).alias("id"), part.cast("int").alias("part"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    bits = bucket_bits(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_KEYS)
    sent = source.mapInArrow(lean(_sender(bits)), f"bucket int, batch long, ids array<{kind}>, blob binary, learn long, weigh long")
    back = sent.groupBy("bucket").applyInArrow(lean(_count), f"batch long, ids array<{kind}>, blob binary, learn long, weigh long, known long, of int")
    met = stored(back.groupBy("batch").applyInArrow(lean(_meet), f"ids array<{kind}>, own binary, buckets array<int>, blobs array<binary>, learn long, weigh long, known long"), "counts")
    n, n_weigh, vocabulary = (int(x or 0) for x in met.agg(F.sum("learn"), F.sum("weigh"), F.sum("known")).first())

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, buckets, blobs in zip(*(b.column(k).to_pylist() for k in range(3))):
                w, v, p, lengths, parts = _events(own, buckets, blobs, bits)
                on = np.repeat(parts, lengths) == 2
                w, v, p = (x[0][on] - x[1][on] for x in (w, v, p))
                code = (context_bucket(v) << 40) + ((_levels(p / np.maximum(v, 1)) + 1) << 20) + _levels(w / max(n - n_weigh, 1)) + 1
                named, count = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(count)], ["code", "n"])

    # cells are bounded by their fineness: CONTEXTS x levels x levels
    rows = met.select("own", "buckets", "blobs").mapInArrow(lean(cells), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([(r["code"] >> 40, (r["code"] >> 20 & 0xFFFFF) - 1, (r["code"] & 0xFFFFF) - 1, r["n"]) for r in rows], float).reshape(-1, 4), vocabulary)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column(0)[k].values
                w, v, p, lengths, parts = _events(*(b.column(c)[k].as_py() for c in (1, 2, 3)), bits)
                if not len(lengths):
                    continue
                w, v, p = w[0], v[0], p[0]
                lam = weights[context_bucket(v)]
                chance = lam[:, 0] * p / np.maximum(v, 1) + lam[:, 1] * w / max(n, 1) + lam[:, 2] / (vocabulary + 1)
                at = np.cumsum(lengths) - lengths
                total = lambda x: np.add.reduceat(x, at)
                base = total(np.log10(w + 1.0)) - lengths * np.log10(n + vocabulary + 1.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(parts == 0), pa.array(lengths), pa.array(total((w > 0).astype(np.int64))), pa.array(np.full(len(lengths), n, np.int64)), pa.array(base), pa.array(total(np.log10(chance)))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.select("ids", "own", "buckets", "blobs").mapInArrow(lean(scores), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document under a model of the training folds."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
