"""Greedy budgets against the plain loop, reviews, sources and node search on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sparloom.operators import nodes, packs, repo


def plain_fill(sizes, budget):
    used, kept = 0, []
    for k, n in enumerate(sizes):
        take = k == 0 or used + n <= budget
        used += n * take
        kept.append(take)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(0.6)) % 4000 if seed % 2 else rng.randint(0, 900) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "k int, n int").repartition(5)
    for budget in (0, 1, 700, 5000, 10**6):
        got = {r["k"]: r["kept"] for r in packs.fill(rows, [F.asc("k")], "n", budget).collect()}
        assert [got[k] for k in range(300)] == plain_fill(sizes, budget), budget


def test_fill_edges(spark):
    rows = spark.createDataFrame([(1, 50), (2, 0), (3, 10), (4, 9)], "k int, n int")
    ask = lambda df, b: {r["k"] for r in packs.fill(df, [F.asc("k")], "n", b).where("kept").collect()}
    assert ask(rows, 10) == {1} and ask(rows, 50) == {1, 2} and ask(rows, 59) == {1, 2, 4} and ask(rows, 60) == {1, 2, 3}
    assert packs.fill(rows.limit(0), [F.asc("k")], "n", 5).count() == 0


def test_review(spark):
    rows = spark.createDataFrame([(1, "a.ts", "door", 1), (2, "b.ts", "nothing", 2), (3, "c.ts", "door door", 3), (4, "d.md", "lock", 4), (5, "e.ts", "door", 5), (6, "f.ts", None, 6)], "id int, source string, text string, recorded int")
    some = lambda *k: rows.where(F.col("id").isin(*k))
    got = {r["id"]: (r["reason"], r["kept"]) for r in packs.budget_review(rows, "door lock", 14, some(4), some(5), some(2)).collect()}
    # pinned, then changed, then by score and authority, the latest first
    assert got == {4: ("pinned", True), 2: ("changed_file", True), 3: ("budget", False), 1: ("budget", False), 5: ("stale", False)}


def test_sources(spark):
    files = spark.createDataFrame([(p, "uses door") for p in ("a.ts", "b.ts", "c.ts", "tests/a.test.ts", "docs/x.md", "z.ts")], "path string, content string")
    edges = spark.createDataFrame([("a.ts#f:1", "b.ts#g:1", "calls"), ("a.ts", "external:x", "imports"), ("c.ts", "a.ts", "imports"), ("a.ts", "a.ts#f:1", "defines")], "src string, dst string, kind string")
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    reached = spark.createDataFrame([("file", "c.ts"), ("test", "tests/a.test.ts"), ("file", "b.ts")], "kind string, node string")
    got = [(r["place"], r["path"], r["reason"]) for r in packs.select_sources(files, edges, path("a.ts", "lost.ts"), path("docs/x.md"), reached, "door z", 10).orderBy("place").collect()]
    assert got == [(1, "a.ts", "changed"), (2, "b.ts", "neighbour"), (3, "docs/x.md", "preferred"), (4, "c.ts", "impacted"), (5, "tests/a.test.ts", "test"), (6, "z.ts", "query")]


def test_nodes(spark, tmp_path):
    files = spark.createDataFrame([("src/a.ts", "typescript", "function openDoor() {\n  closeLock();\n}"), ("src/b.ts", "typescript", "function closeLock() {}")], "path string, language string, content string")
    found, (_, edges) = repo.symbols(files), repo.fact_graph(files)
    communities = spark.createDataFrame([("src/a.ts", "one"), ("src/b.ts", "one")], "node string, community string")
    place = str(tmp_path / "nodes")
    assert nodes.search(files, place, "closelock")[0] == "missing"
    nodes.build(files, found, edges, communities, place)
    state, rows = nodes.search(files, place, "closeLock opendoor")
    got = {r["id"]: r["score"] for r in rows.collect()}
    assert state == "ok" and got == {"graph:file:src/a.ts": 1.0, "graph:symbol:src/a.ts#openDoor:1": 1.0, "graph:symbol:src/b.ts#closeLock:1": 1.0, "graph:file:src/b.ts": 0.5}
    assert {r["id"] for r in nodes.search(files, place, "src one", ["community"])[1].collect()} == {"graph:community:one"}
    assert nodes.search(files, place, "?")[1].count() == 0 and nodes.search(files.limit(1), place, "door")[0] == "stale"
