"""Paths and impact on a small graph."""

from sparloom.operators import relations

EDGES = [
    ("a.ts", "b.ts", "imports", "extracted", 1.0), ("b.ts", "c.ts", "imports", "extracted", 1.0), ("a.ts#f:1", "b.ts#g:2", "calls", "inferred", 0.75), ("b.ts#g:2", "c.ts#h:3", "references", "derived", 0.9),
    ("tests/t.test.ts", "a.ts", "imports", "extracted", 1.0), ("c.ts", "d.ts", "imports", "odd", 0.5), ("a.ts", "external:x", "imports", "extracted", 1.0), ("c.ts", "b.ts", "imports", "extracted", 1.0), ("d.ts", "d.ts", "imports", "extracted", 1.0),
]


def graph(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, kind string, provenance string, confidence double")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_paths(spark):
    ask = lambda a, b, **k: [(r["start"], r["goal"], r["hops"], r["score"]) for r in relations.paths(graph(spark), nodes(spark, *a), nodes(spark, *b), **k).collect()]
    assert ask(["a.ts"], ["c.ts", "d.ts"], depth=3, direction="outbound") == [("a.ts", "c.ts", 2, 0.5), ("a.ts", "d.ts", 3, 0.2667)]
    assert ask(["a.ts"], ["d.ts"], depth=2) == [] and ask(["d.ts"], ["a.ts"], depth=3, direction="outbound") == []
    assert ask(["d.ts"], ["a.ts"], depth=3, direction="inbound") == ask(["d.ts"], ["a.ts"], depth=3) == [("d.ts", "a.ts", 3, 0.2667)]
    assert ask(["a.ts#f:1"], ["c.ts#h:3"], depth=4, kinds=["calls", "references"]) == [("a.ts#f:1", "c.ts#h:3", 2, 0.35)]
    assert ask(["a.ts", "b.ts"], ["c.ts"], depth=3, limit=1) == [("b.ts", "c.ts", 1, 1.0)]
    best = relations.paths(graph(spark), nodes(spark, "a.ts"), nodes(spark, "c.ts"), depth=3).first()
    assert best["route"] == "a.ts -imports-> b.ts | b.ts -imports-> c.ts"


def test_impact(spark):
    files = spark.createDataFrame([("tests/n.test.ts", "uses h here"), ("c.ts", ""), ("tests/o.test.ts", "about c only")], "path string, content string")
    found = spark.createDataFrame([("c.ts#h:3", "c.ts", "function", "h", 3), ("c.ts#k:9", "c.ts", "function", "k", 9)], "id string, path string, kind string, name string, line long")
    changed = spark.createDataFrame([("c.ts",)], "path string")
    hunks = spark.createDataFrame([("c.ts", 3, 0), ("z.ts", 9, 5)], "file string, new_start int, new_lines int")
    out = relations.impact(files, found, graph(spark), changed, hunks, 3)
    got = {(r["kind"], r["node"]): (r["hops"], round(r["confidence"], 4)) for r in out.collect()}
    assert got == {("symbol", "c.ts#h:3"): (0, 1.0), ("file", "b.ts"): (1, 1.0), ("file", "a.ts"): (2, 0.6), ("test", "tests/t.test.ts"): (3, 0.95), ("test", "tests/n.test.ts"): (None, 0.85), ("test", "tests/o.test.ts"): (None, 0.75)}
    assert tuple(relations.risk(out).first()) == (2, 3, "medium")
    whole = {r["node"] for r in relations.impact(files, found, graph(spark), changed, depth=1).where("kind = 'symbol'").collect()}
    assert whole == {"c.ts#h:3", "c.ts#k:9"}
    assert tuple(relations.risk(out.where("kind = 'symbol'")).first()) == (0, 0, "high")


def test_blast_radius(spark):
    got = {(r["kind"], r["name"], r["hops"]) for r in relations.blast_radius(graph(spark), nodes(spark, "c.ts"), 3).collect()}
    assert got == {("file", "b.ts", 1), ("file", "a.ts", 2), ("test", "tests/t.test.ts", 3), ("module", ".", 1), ("module", "tests", 3)}
