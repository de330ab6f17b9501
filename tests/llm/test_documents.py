"""Each operator on documents against a plain version of what it has to give."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparloom.llm import textcore as packing
from sparloom.llm import bpe, decontamination, fingerprints, jaccard, licenses, lm, quality, secrets
from sparloom.llm.textcore import ALNUM, ALNUM_PATTERN, NOT_SPACE, NOT_SPACE_PATTERN, plain_words, word_chunks


@pytest.mark.parametrize("kind,pattern", [(ALNUM, ALNUM_PATTERN), (NOT_SPACE, NOT_SPACE_PATTERN)])
def test_words(corpus, kind, pattern):
    texts = [t for _, t in corpus] + ["Aé B-c\x85d\u2003e", "\x00\x1fz", "a"]
    for limit in (1, 200, 1 << 20):
        got = []
        for lo, hi, w in word_chunks(pa.array(texts), kind, limit=limit):
            got += [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[r], w.first[r + 1])] for r in range(hi - lo)]
        assert got == [plain_words(t, pattern) for t in texts]


def test_licenses(spark, corpus, docs, no_docs):
    got = Counter()
    for r in licenses.find(docs).collect():
        got[r["id"], r["n_words"], tuple((s["label"], s["start"], s["end"]) for s in r["spans"] if s["exact"])] += 1
    want = Counter()
    for i, t in corpus:
        w = plain_words(t, ALNUM_PATTERN)
        spans = [(k, k + len(p.split()), label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), tuple((n, a, z) for a, z, n in sorted(spans))] += 1
    assert got == want
    loose = {r["id"]: {s["label"] for s in r["spans"]} for r in licenses.find(docs.where("doc_id IN (220, 222)")).collect()}
    assert {"gpl", "mit", "apache", "apache-2.0"} <= loose[220] and "apache-2.0" in loose[222]
    assert licenses.find(no_docs).count() == 0


def plain_licenses(text):
    """Spans (label, exact, start, end, score) by one loop for each template."""
    w = plain_words(text, ALNUM_PATTERN)
    out = []
    for exact, named in ((True, licenses.PHRASES), (False, licenses.TEMPLATES)):
        for phrase, label in named.items():
            p = phrase.split()
            by_diagonal = defaultdict(list)
            for at in range(len(w) - 1):
                for t in range(len(p) - 1):
                    if w[at : at + 2] == p[t : t + 2]:
                        by_diagonal[at - t].append((at, t))
            bands = []
            for d in sorted(by_diagonal):
                if not bands or d - bands[-1][-1] > licenses.NEAR:
                    bands.append([])
                bands[-1].append(d)
            for band in bands:
                spans = []
                for d in sorted(band, key=lambda d: (min(by_diagonal[d]), d)):
                    at, t = [a for a, _ in by_diagonal[d]], {t for _, t in by_diagonal[d]}
                    if not exact and spans:
                        s = spans[-1]
                        if abs(d - s["d"]) <= licenses.NEAR and min(t) > s["t"] and min(at) <= s["at"] + 2 + licenses.NEAR:
                            s |= {"d": d, "t": max(t), "at": max(at), "n": s["n"] + len(t)}
                            s["end"] = max(s["end"], max(at) + 2)
                            continue
                    spans.append({"d": d, "t": max(t), "at": max(at), "n": len(t), "start": min(at), "end": max(at) + 2})
                for s in spans:
                    share = s["n"] / (len(p) - 1)
                    if share == 1 if exact else share >= licenses.COVER:
                        out.append((s["start"], s["end"], label, exact, min(share, 1.0)))
    return len(w), tuple(sorted(out))


def test_licenses_repeated_rows(spark):
    """Each row gives a row; copies give what one of them gives: no phrase is lost and no half template passes."""
    texts = [
        "Under the MIT License, or the Apache License; again: MIT license.", "licensed under the apache thing", "licensed under the apache license version 2 0", None, "",
        "this work is licensed under under the gnu general public license version 3", "you may not use this very file except in compliance with the license",
        # a far vote between the parts of a span
        "you may not use this file except license in compliance with the license; the license",
        "licensed under cc by nc 4 0 licensed under cc by 4 0 all rights reserved " * 3,
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    many = licenses.find(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r["id"], r["n_words"] or 0, tuple(tuple(s) for s in r["spans"])) for r in many)
    assert got == Counter((i, *plain_licenses(t)) for i, t in rows * 3) and len(many) == 30
    labels = {r["id"]: {s["label"] for s in r["spans"]} for r in many}
    assert labels[None] == {"mit", "apache"} and not labels[1] and "apache-2.0" in labels[6] & labels[7] and {"cc-by-nc-4.0", "all-rights-reserved"} <= labels[8]


def test_language_model(corpus, docs, no_docs):
    got = defaultdict(list)
    for r in lm.score(docs).collect():
        got[r["id"]].append(r)
    tokens = [(i, plain_words(t, NOT_SPACE_PATTERN) + [None]) for i, t in corpus]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    count = Counter(w for i, t in tokens if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for i, t in tokens:
        want[i].append((held[i], len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert {i: sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for x in got.values() for r in x)
    assert lm.score(no_docs).count() == 0


def test_language_model_scores(corpus, docs):
    """The scores against plain sums over words and pairs."""
    check = {i: zlib.crc32(str(i).encode()) for i, _ in corpus}
    tokens = [(i, plain_words(t, NOT_SPACE_PATTERN) + [None]) for i, t in corpus]
    learn = lambda i: check[i] % 7 != 2
    weigh = lambda i: learn(i) and check[i] // 7 % 10 == 0

    def counted(use):
        words, pairs = Counter(), Counter()
        for i, t in tokens:
            if use(i):
                words.update(t)
                pairs.update(zip([None, *t], t))
        return words, pairs

    words, pairs = counted(learn)
    w0, p0 = counted(lambda i: learn(i) and not weigh(i))
    bucket = lambda n: min(math.ceil(math.log2(n + 1)), lm.CONTEXTS - 1)
    near = lambda f: 2 ** (-round(-math.log2(f) * lm.FINENESS) / lm.FINENESS) if f else 0.0
    events = [(bucket(w0[a]), near(p0[a, b] / max(w0[a], 1)), near(w0[b] / max(w0.total(), 1)), 1 / (len(words) + 1)) for i, t in tokens if weigh(i) for a, b in zip([None, *t], t)]
    assert len(events) > 100
    weights = [[0.4, 0.5, 0.1] for _ in range(lm.CONTEXTS)]
    for _ in range(lm.ROUNDS):
        total = [[1e-6, 1e-6, 1e-3] for _ in weights]
        for c, *f in events:
            x = [u * v for u, v in zip(weights[c], f)]
            for k in range(3):
                total[c][k] += x[k] / sum(x)
        weights = [[x / sum(t) for x in t] for t in total]
    n = words.total()
    want = defaultdict(list)
    for i, t in tokens:
        out = 0.0
        for a, b in zip([None, *t], t):
            u = weights[bucket(words[a])]
            out += math.log10(u[0] * pairs[a, b] / max(words[a], 1) + u[1] * words[b] / n + u[2] / (len(words) + 1))
        want[i].append(round(out, 6))
    got = defaultdict(list)
    for r in lm.score(docs).collect():
        got[r["id"]].append(round(r["score"], 6))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_large_counts():
    """Counts beyond 32 bits travel whole."""
    parts = [np.array([0, 5, 2**32, 2**50]), np.array([1, 2**32 - 1]), np.zeros(0, np.int64)]
    assert [x.tolist() for x in packing.unpacked_numbers(packing.packed_numbers(*parts), 3)] == [p.tolist() for p in parts]
    z = np.array([9, 10], "<u8").view(np.uint8).reshape(2, 8)[:, :6].tobytes()
    blobs = [np.uint32(len(x)).tobytes() + x + k for x, k in ((packing.packed_numbers(np.array([2**33, 1]), np.array([2**33, 1]), np.zeros(0, int), np.zeros(0, int)), z), (packing.packed_numbers(np.array([2**33]), np.array([3]), np.zeros(0, int), np.zeros(0, int)), z[:6]))]
    table = pa.table([pa.array([0, 0], pa.int32()), pa.array([1, 2]), pa.array([None, None], pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array([0, 0]), pa.array([0, 0])], ["bucket", "batch", "ids", "blob", "learn", "weigh"])
    got = lm._count(table)
    assert [packing.unpacked_numbers(x, 4)[0].tolist() for x in got["blob"].to_pylist()] == [[2**34, 1], [2**34]]


def test_language_model_probabilities_add_up():
    weights = lm.learn_weights(np.array([[1, 8, 40, 5], [1, -1, 40, 3], [3, 0, 16, 9]], float), 100)
    assert np.allclose(weights.sum(1), 1) and weights[3, 0] > 0.9
    assert lm.learn_weights(np.zeros((0, 4)), 0)[0].tolist() == [0, 0, 1]


def test_secrets(corpus, docs, no_docs):
    got = Counter((r["id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"])) for r in secrets.find(docs).collect())
    assert got == Counter((i, tuple((s, secrets.RULES[n].kind, e) for s, n, e in secrets.plain(t))) for i, t in corpus)
    assert sum(len(s) for _, s in got) == 5
    assert secrets.find(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert texts[231] == "é" * 10 + " [SECRET:assign] [SECRET:github]" and texts[203] is None


@pytest.mark.parametrize("pattern,query", [("abc", b"abc"), ("ab", True), ("a(bc|de)f", ("or", (("and", (b"abc", b"bcf")), ("and", (b"ade", b"def"))))), ("abcd*ef", ("and", (b"abc",))), ("[0-9]+", True), ("x?abc", ("or", (b"abc", ("and", (b"xab", b"abc")))))])
def test_trigram_queries(pattern, query):
    got = secrets.derive(pattern)
    assert got == query or (isinstance(query, tuple) and len(query[1]) == 1 and got == query[1][0])


def _sets(corpus):
    for i, t in corpus:
        w = plain_words(t, NOT_SPACE_PATTERN)
        yield i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard(corpus, docs, no_docs):
    rows = list(_sets(corpus))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(rows))
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs).collect()) == want
    assert jaccard.grouped(no_docs).count() == 0


@pytest.mark.parametrize("bits", [10])
def test_jaccard_many_buckets(corpus, docs, bits, monkeypatch):
    want = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs).collect())
    score = sorted((r["id"], round(r["score"], 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(jaccard, "bucket_bits", lambda *_: bits)
    monkeypatch.setattr(lm, "bucket_bits", lambda *_: min(bits, 12))
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs).collect()) == want
    assert sorted((r["id"], round(r["score"], 6)) for r in lm.score(docs).collect()) == score


def test_jaccard_large_cell(spark, monkeypatch):
    """Tiles smaller than a group of near copies, some of which reach one another only through others."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 11)):
            w[k] = f"e{i}.{k}"
        rows.append((i, " ".join(w)))
    sets = list(_sets(rows))
    near = {i: {j for j, y in sets if 100 * len(x & y) >= 75 * len(x | y)} for i, x in sets}
    want = {}
    for i in range(150):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = min(seen)
    monkeypatch.setattr(jaccard, "TILE", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in jaccard.grouped(df).collect()} == want


def test_decontamination(spark, corpus, docs, no_docs):
    rng = np.random.default_rng(1)
    long = [t for _, t in corpus if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[20:45])) for k, t in enumerate(long[:9])] + [(50, "the of"), (51, None), (52, ""), (53, "a b c d e"), (54, "unseen " * 30), (54, long[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t, ALNUM_PATTERN)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k : k + 10])].add(str(i))
    want = Counter()
    for i, t in corpus:
        w, hit, found = plain_words(t, ALNUM_PATTERN), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    for limit in (10**6, 30):
        got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.find(docs, bench, limit=limit).collect())
        assert got == want if limit > 30 else set(got) == set(want)
        clean = decontamination.keep_clean(docs, bench, limit=limit)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(i for (i, _, n, _), c in want.items() if not n for _ in range(c))
    assert decontamination.find(no_docs, bench).count() == 0 and decontamination.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert rng is not None


def test_decontamination_null_item(spark, docs, corpus):
    """An item without an id hits, but is in no list."""
    bench = spark.createDataFrame([(None, "GNU General Public License"), (7, "a b c d e")], "item_id long, text string")
    got = {r["id"]: (r["n_hit"], r["items"]) for r in decontamination.find(docs.where("doc_id IN (206, 210, 220)"), bench).collect() if r["n_words"] != 5 or r["n_hit"]}
    assert got == {206: (0, []), 210: (5, ["7"]), 220: (4, [])}
    left = {r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()}
    assert 220 not in left and 206 in left


def test_decontamination_repeated_rows(spark, corpus, docs):
    """Every row of the documents gives a row, in however many passes the test set is searched."""
    items = [(k, " ".join(t.split()[:40])) for k, (_, t) in enumerate(corpus[:20]) if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.unionByName(docs.where("doc_id IN (3, 5)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id IN (3, 203)"))
    rows = lambda limit: Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.find(more, bench, limit=limit).collect())
    one = rows(10**6)
    assert one.total() == more.count() and max(one.values()) >= 6
    n = sum(len(decontamination.windows_of(i, t)) for i, t in items)
    assert rows(30) == one and rows(n) == one
    assert len(list(decontamination.window_passes(bench, "item_id", "text", n))) == 1


def test_bpe(corpus, docs, no_docs):
    import tiktoken

    codec = bpe.codec_of(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = Counter((r["id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs).collect())
    want = Counter()
    for i, t in corpus:
        ids = known.encode_ordinary(t or "")
        want[i, tuple(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = Counter((r["id"], r["text"]) for r in bpe.decode(bpe.encode(docs)).collect())
    assert back == Counter((i, t or "") for i, t in corpus)
    assert bpe.encode(no_docs).count() == 0
    odd = ["a" * 3001, "aaaaab" * 500, "\x1c\x85\u2028\u180e\u200b ſK", "  \n\n x", "ababab'll 12²③ \u0301é", "", "漢字" * 999]
    assert [x.tolist() for x in codec.encode(odd)] == [known.encode_ordinary(x) for x in odd]


def test_quality(spark, corpus, docs, no_docs):
    good = [(i, t) for i, t in corpus if t and len(t.split()) > 5]
    rows = [(k, t, 1) for k, (_, t) in enumerate(good * 4)] + [(1000 + k, " ".join(w + "!!" for w in t.upper().split()), 0) for k, (_, t) in enumerate(good * 4)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(data.select("doc_id", "text"), data.select("doc_id", "quality"))
    scored = quality.score(data, model).join(data.select(F.col("doc_id").alias("id"), "quality"), "id").where(quality.fold("id") == 1).collect()
    assert len(scored) > 50 and np.mean([(r["score"] >= 0.5) == r["quality"] for r in scored]) > 0.95
    assert {r["score"] for r in quality.score(docs.where("doc_id IN (203, 204)"), model).collect()}.__len__() == 1
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(no_docs, quality.fit(no_docs, data.limit(0))).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, data.limit(0))).collect()} == {0.5}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns


def test_quality_vector_per_word(spark):
    """However many words there are, each has the vector of its own contexts."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(9000)]
    rows = [(k, " ".join(rng.permutation(words)[:3000])) for k in range(6)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = quality.context_vectors(df, known_words=50)
    got = {}
    for r in made.table.collect():
        keys = quality._widened(r["keys"]) << np.uint64(16) >> np.uint64(made.bits) | np.uint64(r["bucket"]) << np.uint64(64 - made.bits)
        got.update(zip(keys.tolist(), np.frombuffer(r["codes"], np.uint8).reshape(-1, quality.DIM // 4)))
    w = next(word_chunks(pa.array([" ".join(words)]), NOT_SPACE))[2]
    seen = {x for _, t in rows for x in (t or "").split()}
    whole = dict(zip(words, w.hash.tolist()))
    sent = {x: (k >> 64 - made.bits << 64 - made.bits) | ((k << made.bits) % 2**64 >> 16 << 16 >> made.bits) for x, k in whole.items()}
    assert {sent[x] for x in seen} == set(got) and len(made.known) <= 50
    signed = lambda key: [(int(key >> (8 + 20 * k)) % quality.DIM, 1 if key >> (18 + 20 * k) & 1 else -1) for k in range(quality.PLACES)]
    total = {x: np.zeros(quality.DIM) for x in seen}
    mark = int(quality._shape_keys[0 * 16 + 2 * 4 + 2])  # a small letter, then digits
    for _, t in rows:
        x = (t or "").split()
        for i, word in enumerate(x):
            for key in [whole[x[j]] for j in (i - 1, i + 1) if 0 <= j < len(x)] + [mark]:
                for place, sign in signed(key):
                    total[word][place] += sign
    for word in seen:
        x = total[word]
        vector = np.where(x * x * 4 * quality.DIM >= (x * x).sum(), np.sign(x), 0)
        assert quality.vectors_of(got[sent[word]][None])[0].tolist() == vector.tolist()
    # the mean of a text's words' vectors, however many words are broadcast
    for known in (0, 50, 10**6):
        made = quality.context_vectors(df, known_words=known)
        use = lambda b, x: pa.table([b["doc_id"], pa.array(x[:, : quality.DIM].tolist(), pa.list_(pa.float32()))], ["id", "x"])
        for r in quality.with_vectors(df, 1, [0], made, use, "id long, x array<float>").collect():
            x = (dict(rows)[r["id"]] or "").split()
            want = sum((quality.vectors_of(got[sent[y]][None])[0].astype(int) for y in x), np.zeros(quality.DIM, int)) / max(1, len(x))
            assert np.allclose(r["x"], want, atol=1e-6)
    odd = np.array([[0] * 32 + [k] for k in (0, 1, -1, 127, -128, 256, 2**40)])
    assert (quality._unpacked(quality._packed(odd)) == odd).all()


def test_fingerprints(spark, corpus, docs, no_docs):
    rows = [(r["id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprints.compare_edited(docs).collect()]
    order = sorted(corpus, key=lambda x: -x[0])
    ids = Counter(i for i, _ in corpus)
    want = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest())
    assert len(rows) == len(corpus)
    single = [r for r in rows if ids[r[0]] == 1 and ids[order[(order.index(next(x for x in order if x[0] == r[0])) + 1) % len(order)][0]] == 1]
    assert len(single) > 60 and all(want[r[0]] == r[1:3] for r in single)
    assert all(0 <= r[4] <= 1 and 0 <= r[5] <= 1 for r in rows)
    by_text = defaultdict(set)
    text = {i: t for i, t in corpus}
    for r in rows:
        if ids[r[0]] == 1:
            by_text[text[r[0]] or ""].add(r[3])
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in rows if r[1] > 600]
    assert np.mean([r[4] for r in long]) > np.mean([r[5] for r in long]) + 0.3
    assert fingerprints.compare_edited(no_docs).count() == 0
    assert [r["near_next"] for r in fingerprints.compare_edited(docs.where("doc_id = 5")).collect()] == [1.0]
    equal = {r["id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert equal[200] == equal[3]


def plain_fingerprint(text, counts):
    """The features and filters of a text, window by window."""
    raw, n = (text or "").encode(), fingerprints.WINDOW
    level = lambda x: sum(a == b for k, a in enumerate(x) for b in x[:k])
    at = range(len(raw) - n + 1)
    order = {k: r for r, k in enumerate(sorted(range(fingerprints.LEVELS), key=lambda k: (k >= fingerprints.FLAT, counts[k], k)))}
    rank = [order[level(raw[i : i + n])] for i in at]
    if not raw:
        chosen = None
    elif not rank:
        return [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")]
    elif len(raw) < fingerprints.SHORT:
        chosen = at
    else:
        won = Counter(min(range(k, k + fingerprints.SPAN), key=lambda i: (rank[i], i)) for k in range(len(rank) - fingerprints.SPAN + 1))
        chosen = sorted(i for i, c in won.items() if c >= fingerprints.ELECTED) or [max(won, key=lambda i: (won[i], -i))]
    out = []
    for i in chosen or ():
        h = sum((int(packing._BYTE_KEYS[c]) * pow(packing._BASE, k, 2**64)) for k, c in enumerate(raw[i : i + n])) % 2**64
        h = int(packing.mix(np.array([h], np.uint64))[0])
        if h not in out:
            out.append(h)
    return out


def plain_filters(hashes):
    size = fingerprints.FEATURES
    return [{h >> 11 * k & 2047 for h in hashes[a : a + size] for k in range(fingerprints.BITS)} for a in range(0, len(hashes), size)]


def plain_likeness(x, y):
    if not x or not y:
        return float(len(x) == len(y))

    def one(x, y):
        near = [max(min(1, max(0, (len(a & b) - len(a) * len(b) / 2048) / max(min(len(a), len(b)) - len(a) * len(b) / 2048, 1e-9))) for b in y) for a in x]
        return sum(v * len(a) for v, a in zip(near, x)) / sum(map(len, x))

    return one(x, y) if len(x) < len(y) else one(y, x) if len(x) > len(y) else (one(x, y) + one(y, x)) / 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_plain(spark, corpus, kind, monkeypatch):
    """Digests and likeness against the plain version, for ids of numbers and of strings, in runs of any size."""
    rows = [(None if i == 31 else str(i) if kind == "string" else i, (t or "")[:3000] or t) for i, t in corpus]
    counts = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        counts.update(sum(a == b for k, a in enumerate(raw[i : i + 16]) for b in raw[i : i + k]) for i in range(len(raw) - 15))
    made = {}
    plain = lambda t: made[t] if t in made else made.setdefault(t, plain_filters(plain_fingerprint(t, counts)))
    coded = lambda f: fingerprints.written(np.packbits(np.array([[k in x for k in range(2048)] for x in f], bool).reshape(-1, 2048), axis=1, bitorder="little"))
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    keys = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(rows, key=lambda r: keys[r[1]])
    order.sort(key=lambda r: (r[0] is not None, r[0] or (0 if kind == "long" else "")), reverse=True)
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), coded(plain(t)), coded(plain(e)), round(plain_likeness(plain(t), plain(e)), 9), round(plain_likeness(plain(t), plain(n)), 9)] += 1
    for size in (1 << 23, 4000):
        monkeypatch.setattr(fingerprints, "RUN_BYTES", size)
        got = Counter((r["id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.compare_edited(df).collect())
        assert got == want


def test_likeness_symmetric():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = (fingerprints.filters(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        b[0] |= a[0] & b[-1]
        assert abs(fingerprints.likeness(a, b) - fingerprints.likeness(b, a)) < 1e-12


def test_levels():
    data = np.frombuffer(b"abracadabra " * 20, np.uint8)
    got = fingerprints.levels(data)
    assert got.tolist() == [sum(data[i + a] == data[i + b] for a in range(16) for b in range(a)) for i in range(len(data) - 15)]
