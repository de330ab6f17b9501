"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are put in one global order, rarest first. If two sets reach the similarity, then for any
m they share at least m tokens of their m-prefixes, the first |x| - ceil(t |x|) + m tokens. Each
document picks its m by estimated cost: a longer prefix costs more postings, but more matches
have to agree before a pair is verified. A pair needs min(m_x, m_y) common prefix tokens.

How it runs:

1. Each batch of texts becomes sets of hashed shingles, which travel packed by hash bucket
   (about six bytes a shingle). A shingle that COMMON of a batch's sets have travels once, with their
   number, so that a bucket gets no more of it than one entry a batch, however many documents have it.
   A bucket counts each shingle's documents and sends back those that
   are not alone in having it. A document whose prefix holds only shingles of its own is done.
2. The remaining documents post their prefixes. For each token the most central document (the one
   with the fewest shingles of its own) is the hub. Two documents that share a prefix token meet
   in the cell of that token's hub; large cells are cut into blocks, each of which gets the hub.
3. In a block all are compared with the hub, with prefix matches counted first and whole sets after.
   Those that aren't similar to it are left over. They are compared with all others: in the same task
   where the cell has one block, else in tiles of a block of those left over and a block of the cell.
   What is similar to the hub needs no more comparison with the like. Either step returns
   links that span the groups it found, not all pairs of a group.
4. Links become components by large-star and small-star rounds over tables in the shared folder.

Sets that are equal stand for one unit throughout, so copies cost nothing and aren't paired.

Cases: null and empty texts, or such without words, have an empty set and are linked with nothing;
a text of fewer words than a shingle is one shingle; rows with equal ids are separate members of
their components; a null id can't be the smallest id of a component unless it is alone. Input
columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import NOT_SPACE, batch_numbers, bucket_bits, column_bytes, lean, mix, packed_numbers, row_chunks, segment, stored, tuned, unpacked_numbers

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Bytes of a hash that travel; the bucket stands for the rest.
SENT = 6
#: Shingles in a bucket, about.
BUCKET_TOKENS = 500_000
#: Bytes of text in a batch, about; a longer row is one alone.
BATCH_BYTES = 4 << 20
#: Sets of a batch that have a shingle, from which on it travels once.
COMMON = 3
#: Prefix extensions to choose from, and the cost of a verification in postings.
MATCHES, VERIFY_COST = (1, 2, 4, 8), 20.0
#: Documents of a cell that are compared in one task.
TILE = 2048
#: Pair hits counted at once.
HITS = 1_000_000


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted within each row, and each row's number."""
    data, offs = column_bytes(col)
    sizes, parts = [], []
    for lo, hi in row_chunks(offs):
        w = segment(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], NOT_SPACE)
        at, h = w.grams(SHINGLE, short=True)
        row = w.row[at] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        parts.append(h[new])
        sizes.append(np.bincount(row[new], minlength=hi - lo))
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def unit_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets; 0 for the empty set."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(mix(tokens ^ np.uint64(0x5DEECE66D)), at) + mix(sizes[full].astype(np.uint64))) | np.uint64(1)
    return out.view(np.int64)


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent / 100 x size)."""
    return (size * percent + 99) // 100


def _sender(bits: int):
    """Texts to packed sets: (bucket, batch, ids, blob, sizes, units)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in row_chunks(column_bytes(b.column(1))[1], BATCH_BYTES):
                yield b.slice(lo, hi - lo)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in zip(batch_numbers(), parts(batches)):
            tokens, sizes = shingle_sets(b.column(1))
            units = unit_ids(tokens, sizes)
            # each set once in the batch
            _, first = np.unique(units, return_index=True)
            use = np.zeros(len(units), bool)
            use[first] = True
            use &= sizes > 0
            member = np.repeat(np.arange(len(sizes)), sizes)
            kept = use[member]
            t, m = tokens[kept], member[kept]
            slot = np.cumsum(use) - 1
            m, n = slot[m], int(use.sum())
            order = np.argsort(t, kind="stable")
            t, m = t[order], m[order]
            # common shingles: one entry each, owned by n, n + 1, ...; the own row tells whose they are
            head = np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]])
            start = np.flatnonzero(head)
            times = np.diff(np.concatenate([start, [len(t)]]))
            often = times >= COMMON
            whose = m[np.repeat(often, times)]
            owner = m.copy()
            owner[start[often]] = n + np.arange(often.sum())
            once = np.repeat(~often, times)
            once[start[often]] = True
            t, owner = t[once], owner[once]
            many = np.zeros(len(t), np.int64)
            many[owner >= n] = times[often]
            bucket = (t >> np.uint64(64 - bits)).astype(np.int64)
            named, start = np.unique(bucket, return_index=True)
            # the bytes behind the bucket's own bits
            body = ((t << np.uint64(bits)) >> np.uint64(64 - 8 * SENT)).view(np.uint8).reshape(-1, 8)[:, :SENT]
            blobs = []
            for a, z in zip(start.tolist(), [*start.tolist(), len(t)][1:]):
                # sorted by owner, whose they are takes little
                place = a + np.argsort(owner[a:z], kind="stable")
                o, c = owner[place], many[place]
                head = packed_numbers(np.diff(o, prepend=0), c[c > 0], np.array([n]))
                blobs.append(np.uint32(len(head)).tobytes() + head + body[place].tobytes())
            k = len(blobs)
            own = packed_numbers(np.flatnonzero(use), times[often], whose)
            ids = pa.array([b.column(0).to_pylist(), *[None] * k], pa.list_(b.column(0).type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(mix(np.array([batch], np.uint64))[0] >> np.uint64(64 - bits)), *named.tolist()], pa.int32()), pa.array([batch] * (k + 1), pa.int64()), ids, pa.array([own, *blobs], pa.binary()), pa.array([sizes.astype("<i8").tobytes(), *[None] * k], pa.binary()), pa.array([units.tobytes(), *[None] * k], pa.binary())],
                ["bucket", "batch", "ids", "blob", "sizes", "units"],
            )

    return scan


def _counter(bits: int):
    """One bucket: counts documents by shingle; sends each batch its shared shingles back."""

    def count(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_valid(table["ids"]))
        sent = table.filter(pc.is_null(table["ids"]))
        batches = sent["batch"].to_pylist()
        tokens, owners, weights, cuts = [], [], [], [0]
        for blob in sent["blob"].to_pylist():
            size = int(np.frombuffer(blob, "<u4", 1)[0])
            owner, times, n = unpacked_numbers(blob[4 : 4 + size], 3)
            owner = np.cumsum(owner, dtype=np.int64)
            weight = np.ones(len(owner), np.int64)
            weight[owner >= int(n[0])] = times
            body = np.frombuffer(blob, np.uint8, -1, 4 + size).reshape(-1, SENT)
            wide = np.zeros((len(body), 8), np.uint8)
            wide[:, :SENT] = body
            tokens.append(wide.view("<u8").ravel())
            owners.append(owner)
            weights.append(weight)
            cuts.append(cuts[-1] + len(body))
        columns = [told["batch"].to_pylist(), told["ids"].to_pylist(), told["blob"].to_pylist(), told["sizes"].to_pylist(), told["units"].to_pylist()]
        if tokens:
            t, owner, weight = np.concatenate(tokens), np.concatenate(owners), np.concatenate(weights)
            _, inverse = np.unique(t, return_inverse=True)
            df = np.bincount(inverse, weight).astype(np.int64)[inverse]
            shared = df > 1
            # the whole number again: bucket bits in front
            whole = (t << np.uint64(64 - 8 * SENT)) >> np.uint64(bits) | np.uint64(sent["bucket"][0].as_py()) << np.uint64(64 - bits)
            for k, batch in enumerate(batches):
                z = slice(cuts[k], cuts[k + 1])
                s = shared[z]
                if s.any():
                    columns[0].append(batch)
                    columns[1].append(None)
                    head = packed_numbers(owner[z][s], df[z][s])
                    columns[2].append(np.uint32(len(head)).tobytes() + head + whole[z][s].astype("<u8").tobytes())
                    columns[3].append(None)
                    columns[4].append(None)
        kinds = [pa.int64(), table.schema.field("ids").type, pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "ids", "blob", "sizes", "units"])

    return count


def choose_matches(df: np.ndarray, unique: int, size: int, percent: int) -> tuple[int, int]:
    """(m, prefix tokens that others have too) by least cost; df: ascending document counts of a
    set's shared tokens. (0, 0): no other set can be similar enough."""
    need = int(least_overlap(np.int64(size), percent))
    best = (0, 0)
    least = None
    for m in MATCHES:
        if m > need:
            break
        n = min(size - need + m - unique, len(df))
        if n < m:  # fewer shared tokens than any similar set would match
            return 0, 0
        others = float(np.sum(df[:n] - 1.0))
        cost = others + VERIFY_COST * others / m
        if least is None or cost < least:
            least, best = cost, (m, n)
    return best


def _receiver(percent: int):
    """One batch: its members, and its sets that may have partners with their shared tokens."""

    def receive(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_valid(table["ids"])).slice(0, 1)
        out: dict[str, list] = {k: [] for k in ("id", "n", "unit", "size", "m", "prefix", "alone", "tokens")}
        kinds = [table.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        if told.num_rows:
            ids = told["ids"][0].as_py()
            use, times, whose = (x.astype(np.int64) for x in unpacked_numbers(told["blob"][0].as_py(), 3))
            sizes, units = np.frombuffer(told["sizes"][0].as_py(), "<i8"), np.frombuffer(told["units"][0].as_py(), np.int64)
            out["id"], out["n"], out["unit"] = list(ids), sizes.tolist(), units.tolist()
            for k in ("size", "m", "prefix", "alone", "tokens"):
                out[k] = [None] * len(ids)
            back = [x for x in table.filter(pc.is_null(table["ids"]))["blob"].to_pylist()]
            owner, df, token = [], [], []
            for blob in back:
                size = int(np.frombuffer(blob, "<u4", 1)[0])
                o, d = unpacked_numbers(blob[4 : 4 + size], 2)
                owner.append(o.astype(np.int64))
                df.append(d.astype(np.int64))
                token.append(np.frombuffer(blob, "<u8", len(o), 4 + size))
            if back:
                owner, df, token = np.concatenate(owner), np.concatenate(df), np.concatenate(token)
                # common shingles, each for all sets that have it
                common = np.flatnonzero(owner >= len(use))
                of = owner[common] - len(use)
                reps = times[of]
                inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                more = whose[np.repeat((np.cumsum(times) - times)[of], reps) + inner]
                single = owner < len(use)
                owner, df, token = np.concatenate([owner[single], more]), np.concatenate([df[single], np.repeat(df[common], reps)]), np.concatenate([token[single], np.repeat(token[common], reps)])
                order = np.lexsort((token, df, owner))
                owner, df, token = owner[order], df[order], token[order]
                size_of, unit_of = sizes[use], units[use]
                named, start = np.unique(owner, return_index=True)
                for k, a, z in zip(named.tolist(), start.tolist(), [*start.tolist(), len(owner)][1:]):
                    size = int(size_of[k])
                    m, n = choose_matches(df[a:z], size - (z - a), size, percent)
                    if m:
                        for c, v in zip(out, (None, None, int(unit_of[k]), size, m, n, 1 - (z - a) / size, token[a:z].tobytes())):
                            out[c].append(v)
        return pa.table([pa.array(out[c], k) for c, k in zip(out, kinds)], list(out))

    return receive


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, unit, alone) for every prefix token."""
    for b in batches:
        for unit, n, alone, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            t = np.frombuffer(raw, np.int64, n)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(n, unit, np.int64)), pa.array(np.full(n, alone))], ["token", "unit", "alone"])


def _find(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = int(parent[k])
    return k


def _pair_counts(token: np.ndarray, member: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Common tokens of each of ``rows`` with each of n members, as a matrix."""
    place = np.full(n, -1, np.int64)
    place[rows] = np.arange(len(rows))
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.concatenate([first, [len(token)]]))
    group = np.repeat(np.arange(len(first)), size)
    at = np.flatnonzero(place[member] >= 0)
    hits = size[group[at]]
    total = np.zeros(len(rows) * n, np.int32)
    ends = np.cumsum(hits)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
        part = at[lo:hi]
        reps = size[group[part]]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        other = member[np.repeat(first[group[part]], reps) + inner]
        total += np.bincount(np.repeat(place[member[part]], reps) * n + other, minlength=len(total)).astype(np.int32)
        lo = hi
    return total.reshape(len(rows), n)


class Comparison:
    """Documents of one task, and links that join those that similar pairs join."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        unit = np.array(table["unit"])
        _, first = np.unique(unit, return_index=True)
        table = table.take(pa.array(first))
        self.unit, self.percent = unit[first], percent
        self.sizes, self.m, prefix = (np.array(table[c]).astype(np.int64) for c in ("size", "m", "prefix"))
        tokens = [np.frombuffer(x, np.int64) for x in table["tokens"].to_pylist()]
        n = [len(t) for t in tokens]
        self.n = len(n)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), n)
        self.token = np.concatenate([np.zeros(0, np.int64), *tokens])
        self.early = np.arange(len(self.token)) - np.repeat(np.cumsum(n) - n, n) < prefix[self.owner]
        self.parent = np.arange(self.n)
        self.links: list[tuple[int, int]] = []

    def at(self, units: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.unit, units))

    def roots(self) -> np.ndarray:
        return np.array([_find(self.parent, k) for k in range(self.n)], np.int64)

    def compare(self, rows: np.ndarray) -> None:
        """Each of ``rows`` with all."""
        step = max(1, HITS // (4 * max(1, self.n)))
        for k in range(0, len(rows), step):
            self._compare(rows[k : k + step])

    def _compare(self, rows: np.ndarray) -> None:
        n, sizes = self.n, self.sizes
        matched = _pair_counts(self.token[self.early], self.owner[self.early], rows, n)
        enough = matched >= np.minimum(self.m[rows][:, None], self.m[None, :])
        a, b = np.minimum(sizes[rows][:, None], sizes[None, :]), np.maximum(sizes[rows][:, None], sizes[None, :])
        enough &= 100 * a >= self.percent * b
        enough[np.arange(len(rows)), rows] = False
        root = self.roots()
        enough &= root[rows][:, None] != root[None, :]
        some = np.flatnonzero(enough.any(1))
        if not len(some):
            return
        common = _pair_counts(self.token, self.owner, rows[some], n)
        good = enough[some] & (100 * common >= self.percent * (sizes[rows[some]][:, None] + sizes[None, :] - common))
        for i, j in zip(*(x.tolist() for x in np.nonzero(good))):
            x, y = _find(self.parent, int(rows[some[i]])), _find(self.parent, j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((int(rows[some[i]]), j))

    def found(self, hub: int, left: np.ndarray | None = None) -> pa.Table:
        """(hub, a, b): the links, and with b null the units left over."""
        left = np.zeros(0, np.int64) if left is None else left
        a, b = [int(self.unit[a]) for a, _ in self.links], [int(self.unit[b]) for _, b in self.links]
        return pa.table([pa.array([hub] * (len(a) + len(left)), pa.int64()), pa.array([*a, *self.unit[left].tolist()], pa.int64()), pa.array([*b, *[None] * len(left)], pa.int64())], ["hub", "a", "b"])


def _with_hub(percent: int):
    """One block: its links, and those that the hub left over, if there are more blocks."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        hub, more = key[0].as_py(), key[2].as_py() > 1
        c = Comparison(table, percent)
        c.compare(c.at(np.array([hub])))
        root = c.roots()
        left = np.flatnonzero(root != root[c.at(np.array([hub]))[0]])
        if not more and len(left):
            c.compare(left)
        return c.found(hub, left if more else None)

    return compare


def _leftover(percent: int):
    """One tile: some that the hub left over, with a block of the cell."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        left = np.unique(np.array(table["unit"])[np.array(table["left"])])
        c = Comparison(table, percent)
        c.compare(c.at(left))
        return c.found(key[0].as_py())

    return compare


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of (a, b): root is the smallest node of its component.

    Large-star and small-star rounds; each round's links are written to the shared folder."""
    def stars(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.withColumn("low", F.least("a", "low"))
        out = both.join(low, "a")
        if small:
            # a has smaller neighbours b only; it joins them under the smallest
            return out.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.where("a != low").select("a", F.col("low").alias("b"))).distinct()
        return out.where("b > a AND b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()

    now = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "links")
    mark = None
    for k in range(rounds + 1):
        if k == rounds:
            raise RuntimeError(f"components didn't settle in {rounds} rounds")
        large = stars(now, False)
        now = stored(stars(large, True), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(now.groupBy("b").agg(F.min("b").alias("root")).withColumnRenamed("b", "node").join(now.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", "root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id, n (set size) and unit of every document; links has spanning
    pairs (a, b) of similar units."""
    spark = docs.sparkSession
    tuned(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    bits = bucket_bits(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_TOKENS)
    sent = source.mapInArrow(lean(_sender(bits)), f"bucket int, batch long, ids array<{kind}>, blob binary, sizes binary, units binary")
    back = sent.groupBy("bucket").applyInArrow(lean(_counter(bits)), f"batch long, ids array<{kind}>, blob binary, sizes binary, units binary")
    rows = back.groupBy("batch").applyInArrow(lean(_receiver(percent)), f"id {kind}, n long, unit long, size long, m int, prefix int, alone double, tokens binary")
    rows = stored(rows, "sets")
    members = rows.where("n IS NOT NULL").select("id", "n", "unit")
    # a set that several batches have comes once from each
    sets = rows.where("tokens IS NOT NULL").select("unit", "size", "m", "prefix", "alone", "tokens")
    posts = sets.select("unit", "prefix", "alone", "tokens").mapInArrow(_postings, "token long, unit long, alone double")
    hubs = posts.groupBy("token").agg(F.min(F.struct("alone", "unit")).alias("hub"), (F.min("unit") != F.max("unit")).alias("more")).where("more").select("token", F.col("hub.unit").alias("hub"))
    cells = stored(posts.join(hubs, "token").select("hub", "unit").distinct(), "cells")
    once = sets.groupBy("unit").agg(*[F.min(c).alias(c) for c in ("size", "m", "prefix", "tokens")])
    # the hub is in all blocks of its cell
    counts = cells.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    blocks = cells.join(counts, "hub").withColumn("block", F.explode(F.when(F.col("unit") == F.col("hub"), every).otherwise(F.array(block))))
    found = blocks.join(once, "unit").groupBy("hub", "block", "blocks").applyInArrow(lean(_with_hub(percent)), "hub long, a long, b long")
    found = stored(found, "found")
    left = found.where("b IS NULL").select("hub", F.col("a").alias("unit")).distinct()
    if not left.isEmpty():
        some = left.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("unit", F.lit(1)), F.col("parts")).cast("int")
        sides = some.join(counts, "hub")
        own = left.join(sides, "hub").select("hub", part.alias("part"), F.explode(every).alias("block"), "unit", F.lit(True).alias("left"))
        others = cells.join(sides, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), "unit", F.lit(False).alias("left"))
        more = own.unionByName(others).join(once, "unit").groupBy("hub", "part", "block").applyInArrow(lean(_leftover(percent)), "hub long, a long, b long")
        found = found.unionByName(more)
    return members, found.where("b IS NOT NULL").select("a", "b").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every document; component_id is the component's smallest id."""
    members, links = join(docs, id_col, text_col, percent)
    roots = components(links)
    known = members.join(roots, members["unit"] == roots["node"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("unit") != 0, F.coalesce("root", "unit")).alias("class"))
    least = known.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least"))
    return known.join(least, "class", "left").select("id", "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the component of every document."""
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
