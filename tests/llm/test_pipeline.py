"""The pipeline against a plain version of its stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparloom.llm import quality, secrets
from sparloom.llm.textcore import ALNUM_PATTERN, NOT_SPACE_PATTERN, plain_words

pipeline = pytest.importorskip("corpus_pipeline")


def redacted(text):
    out, end, last = [], 0, -1
    for s, n, e in secrets.plain(text):
        if s >= last:
            out += [text[end:s], f"[SECRET:{secrets.RULES[n].kind}]"]
        last = end = max(last, e)
    return "".join([*out, text[end:]])


def test_pipeline(spark, corpus, tmp_path):
    junk = [(500 + k, " ".join(w + "!!" for w in (t or "z").upper().split())) for k, (_, t) in enumerate(corpus) if t and len(t) > 30]
    rows = corpus + junk
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(corpus[20][1].split()[:40]))], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.fit(docs, labels)
    good = {(r["id"], r["text"]) for r in quality.score(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"), model).where("score >= 0.5").select("id.doc_id", "id.text").withColumnRenamed("doc_id", "id").collect()}
    kept = [r for r in rows if r in good]
    sets = [(lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())(plain_words(t, NOT_SPACE_PATTERN)) for _, t in kept]
    parent = list(range(len(kept)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, r in enumerate(kept):
        if sets[k]:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    stay = sorted([*least.values(), *(r[0] for k, r in enumerate(kept) if not sets[k])])
    words = plain_words(" ".join(corpus[20][1].split()[:40]), ALNUM_PATTERN)
    first = pipeline.STAGES[1][1](spark, pipeline.STAGES[0][1](spark, docs, str(tmp_path)), str(tmp_path))
    assert first.columns == docs.columns
    assert sorted(r["doc_id"] for r in first.collect()) == stay

    got = pipeline.run(spark, str(tmp_path)).collect()
    text = dict(kept)
    windows = lambda t: {tuple(w[k : k + 10]) for w in [plain_words(t, ALNUM_PATTERN)] for k in range(len(w))}
    leaked = {i for i in stay if any(window_of in windows(text[i]) for window_of in [tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))])}
    clean = [i for i in stay if i not in leaked]
    assert sorted(r["doc_id"] for r in got) == clean and 20 not in clean
    for r in got:
        if r["doc_id"] in (230, 231, 50):
            assert r["decoded_sha256"] == hashlib.sha256(redacted(text[r["doc_id"]] or "").encode()).hexdigest()
