"""Ranked search, packing and hard negatives against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparloom.llm import lexical, negatives, packing
from sparloom.llm.textcore import ALNUM_PATTERN, plain_words


def plain_ranking(docs, queries, k):
    """(query row, rank, id, score) by the formula."""
    counts = [(i, Counter(plain_words(t, ALNUM_PATTERN))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    many, whole = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for q, (item, text) in enumerate(queries):
        scores = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * many) // whole
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_words(text, ALNUM_PATTERN)) if c[t])
            if s > 0:
                scores.append((-s, -1 if i is None else i))
        out += [(item, r + 1, None if i < 0 else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("limit", [20, lexical.PAIRS_PER_PASS])
def test_lexical(spark, corpus, docs, monkeypatch, limit):
    rng = random.Random(5)
    words = [w for _, t in corpus for w in plain_words(t, ALNUM_PATTERN)]
    asked = [(k, " ".join(rng.sample(words, n))) for k, n in enumerate((1, 2, 3, 7, 30, 200))]
    asked += [(9, None), (10, ""), (11, "none-of-these"), (12, words[0] + " " + words[0].upper()), (None, words[3]), (3, words[9]), (3, words[9])]
    queries = spark.createDataFrame([(i, t, 1, "z") for i, t in asked], "item_id long, text string, rank int, doc_id string")
    index = lexical.build(docs)
    for k in (1, 5, 50):
        got = Counter(tuple(r) for r in lexical.search(index, queries, k, limit=limit).collect())
        assert got == plain_ranking(corpus, asked, k)
    assert index.rows.where("term IS NOT NULL").agg({"df": "sum"}).first()[0] == sum(len(set(plain_words(t, ALNUM_PATTERN))) for _, t in corpus)


def test_lexical_blocks(spark, corpus, monkeypatch):
    """Small blocks, a long text in pieces, ids of another type, ties at the end of the k."""
    rows = [(f"d{i}", t) for i, t in corpus] + [(f"t{k:03}", "tie word") for k in range(300)] + [(None, "tie word")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    asked = [(1, "tie"), (2, corpus[0][1])]
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in lexical.search(lexical.build(docs), spark.createDataFrame(asked, "item_id long, text string"), 50).collect()}
    assert [got[1, r][0] for r in range(1, 51)] == [None] + [f"t{k:03}" for k in range(49)]
    assert got[2, 1][0] == "d0"
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 64)
    long = " ".join(f"w{k % 40}" for k in range(500)) + " " + "x" * 9000
    for texts in ([long], [None, "a b", long, "", "c"]):
        import pyarrow as pa

        found = Counter()
        for lo, _, w in lexical.pieces(pa.array(texts, pa.string())):
            found.update((lo + r, w.data[a:z].tobytes().decode()) for r, a, z in zip(w.row.tolist(), w.start, w.end))
        assert found == Counter((k, x) for k, t in enumerate(texts) for x in plain_words(t, ALNUM_PATTERN))


def test_lexical_arithmetic():
    rng = np.random.default_rng(1)
    values, weights = rng.integers(0, 1 << 20, (6, 130)), rng.integers(0, 20_000, 6)
    values[rng.random(values.shape) < 0.5] = 0
    data, df = [], []
    for v in values:
        at = np.flatnonzero(v)
        blob, offs = lexical.packed(np.array([len(at)]), at, v[at])
        data.append(blob.tobytes())
        df.append(len(at))
    bits = lexical.weighted(lexical.opened(data, np.array(df), 3), weights)
    total = np.zeros((len(bits) + 3, 1, 3), np.uint64)
    for t in range(6):
        lexical.add(total, bits[:, [t]])
    want = (values * weights[:, None]).sum(axis=0)
    for k in (1, 10, 200):
        _, place, score = lexical.best(total, k)
        order = np.lexsort((np.arange(130), -want))
        assert sorted(place.tolist()) == sorted(x for x in order[:k].tolist() if want[x] > 0)
        assert (score == want[place]).all()


def test_lexical_empty(spark, docs, no_docs):
    queries = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(lexical.build(no_docs), queries).count() == 0
    assert lexical.search(lexical.build(docs), queries.limit(0)).count() == 0


def plain_negatives(rows, anchors, positives, negatives_, low, high):
    """All of it by comparing every anchor with every row."""
    first = lambda i: (i is not None, i)
    rows = [(i, y, v) for i, y, v in rows if y is not None and v is not None and None not in v]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in anchors if y is not None and v is not None and None not in v}:
        dot = [(sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows]
        by = lambda some: sorted(some, key=lambda r: (-r[0], first(r[1])))
        for p, j, _ in by(r for r in dot if r[2] == y and (r[1] != i or i is None))[:positives]:
            fits = by(r for r in dot if r[2] != y and low * p <= 100 * r[0] <= high * p)[:negatives_]
            out += [(i, j, n + 1, r[1], p, r[0]) for n, r in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize("scale,limit", [(60, 1000), (60, 3), (2**28, 1000)])
def test_negatives(spark, monkeypatch, scale, limit):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    rng = random.Random(9)
    vector = lambda n=8: [int(rng.gauss(0, scale)) for _ in range(n)]
    rows = [(i, i % 3, vector()) for i in range(400)]
    rows += [(1000 + i, i % 3, [scale, scale, 0, 0, 0, 0, 0, 0]) for i in range(200)]  # one vector many times
    rows += [(2000, None, vector()), (2001, 1, None), (2002, 1, [None, *vector(7)]), (2003, 2, vector(5)), (2004, 2, []), (None, 1, vector()), (3, 0, vector()), (5, 2, rows[5][2]), (2005, 9, vector())]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<long>, pivot string, rank int").repartition(3)
    some = [r for r in rows if r[0] is not None and r[0] % 50 in (0, 3, 5)]
    anchors = table.where("vec_id % 50 IN (0, 3, 5)")
    index = negatives.build(table)
    for args in ((5, 10, 30, 90), (2, 3, -100, 100)):
        got = Counter(tuple(r) for r in negatives.mine(index, anchors, positives=args[0], negatives=args[1], low=args[2], high=args[3], limit=limit).collect())
        assert got == plain_negatives(rows, some, *args)


def test_negatives_cases(spark):
    names = spark.createDataFrame([(f"v{i}", i % 2, [float(i % 7), 1.0]) for i in range(50)], "vec_id string, label int, embedding array<double>")
    got = Counter(tuple(r) for r in negatives.mine(negatives.build(names), names.where("vec_id = 'v6'")).collect())
    assert got == plain_negatives([(f"v{i}", i % 2, [i % 7, 1]) for i in range(50)], [("v6", 0, [6, 1])], 5, 10, 30, 90)
    assert negatives.mine(negatives.build(names.limit(0)), names).count() == 0
    assert negatives.mine(negatives.build(names), names.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (4, [None, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in negatives.quantised(odd).collect()] == [(1, [128, -1])]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("cut,window", [(True, 1024), (False, 1024), (True, 64)])
def test_packing(spark, corpus, docs, cut, window):
    rows = packing.pack(docs.repartition(2), cut=cut, window=window).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    want = defaultdict(Counter)
    for (i, _), x in zip(corpus, plain_ids([t for _, t in corpus])):
        want[i][tuple(x)] += 1
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        tokens = Counter((r["doc_tokens"], r["start"] + k, t) for r in pieces for k, t in enumerate(r["ids"]))
        assert tokens == Counter((len(x), k, t) for x, n in want[i].items() for _ in range(n) for k, t in enumerate(x))
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= window
    if cut:  # each of two tasks pads less than a window
        assert len(by_window) * window - sum(r["length"] for r in rows) < 2 * window
    whole = packing.sequences(packing.pack(docs.repartition(2), cut=cut, window=window), window).collect()
    assert all(len(r["ids"]) == window or r["length"].bit_count() == 1 and len(r["ids"]) == r["length"] for r in whole)
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in rows)


def test_packing_words(spark, no_docs):
    rng = random.Random(4)
    texts = ["", " ", "  a  b ", "a\n b\t c  d", "it's we'll 'tis 's", "x y  z", "a <|endoftext|> b", "é ü 12 345 1234567 !!! ...", "\x1c a \x1f b", "w" * 5000 + " q"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", " ", "\n", ".", "'s", "1", "　", "界", "\x85"]) for _ in range(60)) for _ in range(400)]
    encoder = packing.Encoder(public_tokenizers.path(packing.RANK_FILE), public_tokenizers.PATTERN)
    got = [np.frombuffer(x, "<u4").tolist() + [0] for lo in range(0, len(texts), 9) for x in encoder.encode(texts[lo : lo + 9])]
    assert got == plain_ids(texts)
    assert packing.pack(no_docs).count() == 0


def test_differencing():
    assert packing.differencing([8, 7, 6, 5, 4], 2) == [[1, 2, 4], [0, 3]] or sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(2)
    for k in (1, 2, 5, 40):
        for n in (1, 3, 50, 200):
            sizes = [rng.randint(1, 1000) for _ in range(n)]
            groups = packing.differencing(sizes, k)
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) <= k
            if n >= 5 * k:
                assert max(sums) - min(sums) < 400
            for cut in (True, False):
                windows = packing.dealt(sizes, 1024, cut)
                assert all(sum(z - a for _, a, z in g) <= 1024 for g in windows)
                parts = sorted(p for g in windows for p in g)
                assert all(a[2] == b[1] if a[0] == b[0] else (a[2], b[1]) == (sizes[a[0]], 0) for a, b in zip(parts, parts[1:]))
                assert len(windows) == -(-sum(sizes) // 1024) or not cut
