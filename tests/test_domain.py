"""The domain index on a few entities."""

from sparloom.operators import domain


def test_index_and_slice(spark, tmp_path):
    entities = spark.createDataFrame([("file", "a.ts", "a", "1"), ("file", "a.ts", "other", "2"), ("file", "b.ts", "b", "1"), ("table", "t", "t", "1"), ("feature", "f", "F", "1"), ("feature", "g", "G", "1"), ("file", None, "x", "1")], "kind string, key string, name string, source string")
    references = spark.createDataFrame([("feature", "f", "file", "a.ts", "files"), ("feature", "f", "file", "a.ts", "files"), ("file", "a.ts", "file", "b.ts", "imports"), ("file", "b.ts", "table", "t", "reads"), ("feature", "g", "file", "lost.ts", "files"), ("feature", "g", "table", "t", "tables")], "from_kind string, from_key string, to_kind string, to_key string, why string")
    place = str(tmp_path / "domain")
    domain.build([entities], [references], place)
    assert {tuple(r) for r in domain.summary(spark, place).select("kind", "entities", "outgoing", "unresolved", "unreferenced").collect()} == {("file", 2, 2, 0, 0), ("table", 1, 0, 0, 0), ("feature", 2, 3, 1, 2)}
    start = spark.createDataFrame([("feature", "f"), ("feature", "none")], "kind string, key string")
    ask = lambda depth, kinds=None: {(r["kind"], r["key"], r["name"], r["hops"]) for r in domain.slice_of(spark, place, start, depth, kinds).collect()}
    assert ask(0) == {("feature", "f", "F", 0)}
    assert ask(2) == {("feature", "f", "F", 0), ("file", "a.ts", "a", 1), ("file", "b.ts", "b", 2)}
    assert {k for _, k, _, _ in ask(9)} == {"f", "a.ts", "b.ts", "t", "g"}
    assert {k for _, k, _, _ in ask(9, ["feature", "file"])} == {"f", "a.ts", "b.ts"}
