"""Hard-negative mining over one-dimensional distance keys.

Vectors of whole numbers get one more component, the root of the largest squared length less their own, so that the
nearest vectors to (anchor, 0) are those of the highest inner products. Each row is stored under its key, (nearest
pivot, distance to it): the index is sorted by key and cut into leaves, each an interval of distances at one pivot.
By the triangle inequality a leaf's interval is an annulus around its pivot that bounds every inner product in it
from both sides. An anchor scans annuli outwards from its own key; it stops when the bound of all that remain is below
the last of its top k. A first round scans the annuli at the anchors' own keys only; its k-th scores are where the
second round, over all leaves, begins.

An anchor's positives are its best rows of the same label. Negatives are the best rows of other labels whose score
lies in a window that each positive sets. Scores are exact; the index only spares work.

Cases: rows with a null label, a null vector or a null component take no part; the query also leaves out non-finite
components. Shorter vectors count as if filled with zeros. A row isn't another row to those of its own id; rows that
repeat an id are rows like any other, but an anchor that repeats whole is mined once. Null ids take part, are first
among equal scores, and are no anchors of the query. Equal scores come by ascending id. Empty tables give no rows.
Other input columns are ignored. Scores past 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import lean, stored, tuned

#: Vectors that keys are measured from: rows of the smallest hashes of id and vector, over all rows.
PIVOTS = 64
#: Rows of a leaf at most, and leaves looked at together.
LEAF_ROWS = 256
LEAVES_AT_ONCE = 16
#: Rows of the index that one task sorts.
ROWS_PER_TASK = 1 << 16
#: Anchors of one pass over the index; they meet on the driver and go to every task.
ANCHORS_PER_PASS = 1 << 14
#: Anchors scored at once.
ANCHORS_AT_ONCE = 512
#: Squared lengths up to which sums of doubles are exact.
EXACT = 2**53
#: Scores that stand for no bound.
LEAST, MOST = -(2**63), 2**63 - 1


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as doubles, filled with zeros."""
    n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(col), dims))
    if len(col):
        flat = col.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(col)), n)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


@dataclass
class Space:
    """What all keys share: dimensions, the largest squared length, the pivots with their further component."""

    dims: int
    longest: float
    pivots: np.ndarray

    @property
    def kind(self) -> str:
        """How components are stored."""
        return "<i2" if self.longest < 2**30 else "<f8"

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each lifted row to each pivot."""
        sq = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, sq))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows."""
        if self.longest < EXACT:
            return (a @ b.T).astype(np.int64)
        whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
        return np.dot(whole(a), whole(b).T).astype(np.int64)


@dataclass
class Index:
    """leaves: pivot, lo, hi (of distances), ids, labels, vectors (packed)."""

    leaves: DataFrame
    space: Space


def cleaned(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, vector (array<long>) of the rows that take part."""
    vector = F.col(vector_col).cast("array<bigint>")
    out = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    return out.where("label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")


def build(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> Index | None:
    """The index of all rows, sorted by key and written to the shared folder; None if no row takes part."""
    spark = rows.sparkSession
    tuned(spark)
    clean = cleaned(rows, id_col, label_col, vector_col)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x.cast("double"))
    n, dims, longest = clean.agg(F.count("*"), F.max(F.size("vector")), F.max(length)).first()
    if not n:
        return None
    chosen = clean.select(F.xxhash64("id", "vector").alias("h"), "vector").distinct().orderBy("h", "vector").limit(PIVOTS).toArrow()
    space = Space(max(1, dims), longest, np.zeros((0, max(1, dims) + 1)))
    space.pivots = space.lifted(matrix(chosen["vector"].combine_chunks(), space.dims))
    kind = dict(clean.dtypes)["id"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), space.dims)
            far = space.distances(space.lifted(x))
            near = far.argmin(axis=1)
            raw = [r.tobytes() for r in x.astype(space.kind)]
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near]), b.column(0), b.column(1), pa.array(raw, pa.binary())], ["pivot", "distance", "id", "label", "vector"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, far = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(pivot)) + 1, len(pivot))
            lo = 0
            out = []
            for end in ends.tolist():
                while lo < end:
                    hi = min(end, lo + LEAF_ROWS)
                    out.append((lo, hi))
                    lo = hi
            if not out:
                continue
            a = np.array(out)
            offs = pa.array(np.append(a[:, 0], a[-1, 1]).astype(np.int32))
            cols = [pa.array(pivot[a[:, 0]]), pa.array(far[a[:, 0]]), pa.array(far[a[:, 1] - 1])]
            cols += [pa.ListArray.from_arrays(offs, b.column(2)), pa.ListArray.from_arrays(offs, b.column(3))]
            cols.append(pa.array([b"".join(b.column(4)[i].as_py() for i in range(x, y)) for x, y in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["pivot", "lo", "hi", "ids", "labels", "vectors"])

    keyed = clean.mapInArrow(lean(keys), f"pivot int, distance double, id {kind}, label long, vector binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_TASK))
    dealt = keyed.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    packed = dealt.mapInArrow(lean(leaves), f"pivot int, lo double, hi double, ids array<{kind}>, labels array<long>, vectors binary")
    return Index(stored(packed, "leaves"), space)


@dataclass
class Asked:
    """Anchors with their windows: vectors, labels, ids; least and most scores and k-th scores so far [anchor, window]."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: pa.Array
    least: np.ndarray
    most: np.ndarray
    kth: np.ndarray
    same: bool
    k: int


def scanned(space: Space, asked: Asked, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, row, score) that may belong to the top k, from some leaves. rows: of each leaf its first
    row's number, labels and vectors. asked.kth rises on the way."""
    q = np.column_stack([asked.vectors, np.zeros(len(asked.vectors))])
    far = space.distances(q)[:, pivot]
    size = (q * q).sum(axis=1)[:, None] + space.longest
    slack = 1 + 1e-9 * size
    least_far = np.maximum(0, np.maximum(far - hi, lo - far))
    top, bottom = (size - least_far**2) / 2 + slack, (size - (far + hi) ** 2) / 2 - slack
    here = (far >= lo) & (far <= hi)
    for leaf in np.argsort(least_far.mean(axis=0), kind="stable").tolist():  # outwards
        bound = np.maximum(asked.least, asked.kth)
        wanted = (top[:, leaf, None] >= bound) & (bottom[:, leaf, None] <= asked.most)
        some = np.flatnonzero(wanted.any(axis=1) & (here[:, leaf] if first_only else True))
        if not len(some):
            continue
        first, labels, vectors = rows[leaf]
        score = space.products(asked.vectors[some], vectors)
        fits = (labels[None, :] == asked.labels[some, None]) == asked.same
        for w in range(asked.least.shape[1]):
            good = fits & (score >= bound[some, w, None]) & (score <= asked.most[some, w, None])
            a, r = np.nonzero(good)
            if len(a) == 0:
                continue
            value = score[a, r]
            yield some[a], np.full(len(a), w), first + r, value
            if not asked.same:
                # the k-th of this leaf alone; rows of the anchor's own id are no trouble here
                order = np.lexsort((-value, a))
                heads = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) > 0]))
                many = np.diff(np.append(heads, len(order)))
                full = np.flatnonzero(many >= asked.k)
                at = some[a[order[heads[full]]]]
                asked.kth[at, w] = np.maximum(asked.kth[at, w], value[order[heads[full] + asked.k - 1]])


def search(index: Index, asked: Asked, first_only: bool = False) -> DataFrame:
    """anchor (number), window, id, score: the k best rows of each window of each anchor."""
    spark, space = index.leaves.sparkSession, index.space
    sent = spark.sparkContext.broadcast(asked)
    kind = dict(index.leaves.dtypes)["ids"].removeprefix("array<")[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value
        kth = whole.kth.copy()  # of this task
        for b in batches:
            for at in range(0, b.num_rows, LEAVES_AT_ONCE):
                part = b.slice(at, LEAVES_AT_ONCE)
                ids, labels = part.column(3).flatten(), part.column(4).flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column(3)).to_numpy())])
                vectors = [np.frombuffer(x.as_py(), space.kind).astype(float).reshape(-1, space.dims) for x in part.column(5)]
                rows = [(ends[i], labels[ends[i] : ends[i + 1]], v) for i, v in enumerate(vectors)]
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                for lo in range(0, len(whole.vectors), ANCHORS_AT_ONCE):
                    cut = slice(lo, lo + ANCHORS_AT_ONCE)
                    some = Asked(whole.vectors[cut], whole.labels[cut], whole.ids[lo : lo + ANCHORS_AT_ONCE], whole.least[cut], whole.most[cut], kth[cut], whole.same, whole.k)
                    got = list(scanned(space, some, *(part.column(i).to_numpy() for i in range(3)), rows, first_only))
                    if not got:
                        continue
                    a, w, r, s = (np.concatenate(x) for x in zip(*got))
                    if whole.same:  # other rows only
                        mine = pc.fill_null(pc.equal(ids.take(pa.array(r)), some.ids.take(pa.array(a))), False).to_numpy(zero_copy_only=False)
                        a, w, r, s = (x[~mine] for x in (a, w, r, s))
                    by = np.lexsort((order[r], -s, w, a))
                    a, w, r, s = (x[by] for x in (a, w, r, s))
                    group = a * whole.least.shape[1] + w
                    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0])) if len(group) else group
                    nth = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
                    full = np.flatnonzero(nth == whole.k - 1)
                    kth[lo + a[full], w[full]] = np.maximum(kth[lo + a[full], w[full]], s[full])
                    keep = nth < whole.k
                    yield pa.RecordBatch.from_arrays([pa.array(lo + a[keep]), pa.array(w[keep]), ids.take(pa.array(r[keep])), pa.array(s[keep])], ["anchor", "window", "id", "score"])

    found = index.leaves.mapInArrow(lean(scan), f"anchor long, window long, id {kind}, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k)


def seeded(index: Index, asked: Asked) -> Asked:
    """The same question, beginning from the k-th scores in the annuli at the anchors' own keys."""
    last = search(index, asked, first_only=True).where(F.col("rank") == asked.k).select("anchor", "window", "score").toArrow()
    asked.kth[last["anchor"].to_numpy(), last["window"].to_numpy()] = last["score"].to_numpy()
    return asked


def mine(index: Index | None, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, limit: int = ANCHORS_PER_PASS) -> DataFrame:
    """anchor, positive, rank, negative and their scores, ranks from 1, over each anchor's ``positives`` best rows of
    its label and their ``negatives`` best rows of other labels, from low to high hundredths of the positive's score.
    Anchors go over the index in passes of ``limit``; only a pass and its positives meet on the driver."""
    spark = anchors.sparkSession
    tuned(spark)
    kind = dict(anchors.dtypes)[id_col]
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    if index is None:
        return out
    held, ids, labels = [], [], []

    def one_pass() -> DataFrame:
        vectors = np.array(held)
        many = len(vectors)
        none = np.full((many, 1), LEAST)
        asked = Asked(vectors, np.array(labels), pa.array(ids, type=id_type), none, np.full((many, 1), MOST), none.copy(), True, positives)
        got = search(index, seeded(index, asked)).select("anchor", "id", "score", "rank").toArrow()
        least, most = np.full((many, positives), MOST), np.full((many, positives), LEAST)
        at, nth = got["anchor"].to_numpy(), got["rank"].to_numpy() - 1
        score = got["score"].to_pylist()
        least[at, nth] = [-(-low * s // 100) for s in score]
        most[at, nth] = [high * s // 100 for s in score]
        asked = Asked(vectors, asked.labels, asked.ids, least, most, np.full(least.shape, LEAST), False, negatives)
        found = search(index, seeded(index, asked))
        first = spark.createDataFrame(pa.table([got["anchor"], pa.array(nth.astype(np.int64)), got["id"], got["score"], asked.ids.take(got["anchor"])], ["anchor", "window", "positive_id", "positive_score", "anchor_id"]))
        joined = found.join(F.broadcast(first), ["anchor", "window"])
        return joined.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    distinct = cleaned(anchors, id_col, label_col, vector_col).distinct()
    id_type = distinct.select("id").limit(0).toArrow().schema.field(0).type
    rows = distinct.toLocalIterator()
    for r in rows:
        ids.append(r["id"])
        labels.append(r["label"])
        held.append([float(x) for x in r["vector"]] + [0.0] * (index.space.dims - len(r["vector"])))
        if len(held) == limit:
            out = out.unionByName(stored(one_pass(), "negatives"))
            held, ids, labels = [], [], []
    return out.unionByName(one_pass()) if held else out


def quantised(rows: DataFrame, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose components are all finite, each multiplied by scale and rounded down."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(x.isNotNull() & finite).withColumn(vector_col, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: hard negatives of every hundredth row, against all rows."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(build(rows), rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH clean AS (
  SELECT rowid AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM (SELECT row_number() OVER () AS rowid, * FROM embeddings)
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM clean a JOIN clean b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM pairs WHERE same) WHERE n <= 5),
neg AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank
  FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
