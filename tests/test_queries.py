"""Every query of the library proper against its oracle, and operators on small fixtures."""

import duckdb
import pytest

from sparloom.functions import paths, text, urls
from sparloom.operators import discovery, events, explore, graph, repo, reviews, search
from sparloom.plans import catalogue
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.ORACLES:
        cur = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_stems(spark):
    assert one(spark, text.semantic_tokens(F.lit("Queries running classes is as the bus a"))) == ["as", "bus", "classe", "is", "query", "runn", "the"]


def test_semantic_search(spark):
    rows = spark.createDataFrame([("dock", "Cranes lift crates while ships wait."), ("mill", "Stone wheels grind the wheat.")], "id string, text string")
    assert [tuple(r) for r in search.semantic(rows, "id", "text", "lifted crate cranes").collect()] == [("dock", 0.6667)]
    assert search.lexical(rows.select(F.col("id").alias("path"), F.lit("en").alias("language"), "text"), "  ").count() == 0


def test_reward(spark):
    lit = F.lit
    r = lambda e: one(spark, events.reward(lit(True), lit(e), lit(0.0), lit(0), lit(0), lit(20000.0), lit(12000.0)))
    assert r(4) == 11.4267 and r(99) == r(6)
    assert one(spark, events.q_fold(F.array(lit(10.0), lit(-8.0), lit(10.0)), 0.3, 1)) == 2.79


def test_components_and_cycles(spark):
    e = spark.createDataFrame([("src/api", "src/db"), ("docs/usage", "docs/design")], "src string, dst string")
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {"src/api": "src/api", "src/db": "src/api", "docs/usage": "docs/design", "docs/design": "docs/design"}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}
    long = spark.range(600).selectExpr("md5(string(id)) AS src", "md5(string(id + 1)) AS dst")
    assert graph.components(long, 12).select("component").distinct().count() == 1
    assert graph.strongly_connected(chain).count() == 0
    assert [r["hops"] for r in graph.hops(chain, spark.createDataFrame([(0,)], "node long"), 3).orderBy("hops").collect()] == [0, 1, 2, 3]


def test_directions(spark):
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "c", "imports"), ("b", "a", "calls")], "src string, dst string, kind string")
    ask = lambda *a, **k: sorted(tuple(r) for r in graph.between(e, *a, **k).collect())
    assert ask("outbound", src=["b"], kinds=["imports"]) == [("b", "c", "imports")]
    assert ask("inbound", src=["b"]) == [("a", "b", "imports")]
    assert ask("inbound", dst=["a"]) == [("b", "a", "calls")]
    assert len(ask("both", src=["b"])) == 3


def test_as_of_and_diff(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 7, 70)], "k string, t long, v long")
    assert {r["id"]: r["right_v"] for r in events.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: 50, 2: None, 3: None}
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "p string, h int"), spark.createDataFrame([("x", 1), ("y", 3), ("w", 4)], "p string, h int")
    assert {tuple(r) for r in events.snapshot_diff(a, b, "p", "h").collect()} == {("y", "modified"), ("z", "deleted"), ("w", "added")}


def test_urls_and_paths(spark):
    u = F.lit("https://Harbour.example:8443/v2/berths/77/?tide=3&bow=1&bow=2#mast")
    assert one(spark, urls.origin(u)) == "https://harbour.example:8443" and one(spark, urls.path_template(u)) == "/v2/berths/{id}" and one(spark, urls.query_keys(u)) == ["bow", "tide"]
    assert [one(spark, urls.status_class(F.lit(c))) for c in (204, 404, 99)] == ["2xx", "4xx", None]
    assert [one(spark, paths.lane(F.lit(p))) for p in ("src/a.ts", "tests/a.ts", "docs/x.md", "dist/a.js", "perf/a.ts", "testdata/a.json")] == ["runtime", "tests", "docs", "generated", "benchmarks", "fixtures"]
    assert [one(spark, F.lit(p).rlike(paths.glob_regex("src/**/*.t?"))) for p in ("src/a/b.ts", "src/b.ts", "src/a/b.tsx")] == [True, False, False]


def test_waves_and_conflicts(spark):
    got = {r["task"]: r["wave"] for r in discovery.waves(spark.createDataFrame([("a", 0, [], ["p"]), ("b", 1, [], ["p"]), ("c", 2, ["b"], [])], "task string, ord int, deps array<string>, writes array<string>")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_log_replay(spark, tmp_path):
    from pyspark.sql import types as T

    from sparloom.sources import logs

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
    place = str(tmp_path / "log")
    for k in range(3):
        logs.append(spark.createDataFrame([(k, "x")], schema).coalesce(1), place)
    assert sorted(r["id"] for r in logs.replay(spark, place, schema).collect()) == [0, 1, 2]
    with open(f"{place}/zz-last.json", "w") as f:
        f.write('{"id": 7, "kind": "y"}\n\n{"id": 8, "ki')
    with pytest.raises(ValueError):
        logs.replay(spark, place, schema)
    assert sorted(r["id"] for r in logs.replay(spark, place, schema, tolerate_last=True).collect()) == [0, 1, 2, 7]


def test_private_addresses(spark):
    ask = lambda a: one(spark, urls.is_private_address(F.lit(a)))
    assert all(ask(a) for a in ("0.1.2.3", "239.0.0.1", "169.254.1.1", "::", "::ffff:10.0.0.1", "fd00::1", "LOCALHOST", "metadata.google.internal"))
    assert not any(ask(a) for a in ("1.2.3.4", "100.63.0.1", "172.32.0.1", "fdx.example", "2001:db8::1"))


def test_normalised_paths(spark):
    ask = lambda p: one(spark, repo.normalised(F.lit(p)))
    assert [ask(p) for p in ("a/./b/../c", "../a", "a/../..", "a/../b", "/x//y")] == ["a/c", None, None, "b", "x/y"]


def test_strongly_connected(spark):
    """Two cycles that a bridge joins, a larger one whose smallest node is late, and a tail."""
    e = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 9), (9, 12), (12, 15), (15, 9), (15, 15), (12, 7), (7, 12), (20, 1)]
    got = {r["node"]: r["scc"] for r in graph.strongly_connected(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 7: 7, 9: 7, 12: 7, 15: 7}


def test_waves_cycle(spark):
    with pytest.raises(ValueError):
        discovery.waves(spark.createDataFrame([("a", 0, ["b"], []), ("b", 1, ["a"], [])], "task string, ord int, deps array<string>, writes array<string>"), 4)


def test_mission_needs_its_start(spark):
    with pytest.raises(ValueError):
        reviews.mission_states(spark.createDataFrame([(1, 1, "round.started", "t", "1")], "mission long, seq long, type string, key string, value string"))


def test_joined_routes(spark):
    join = lambda a, b: one(spark, explore.joined_route(F.lit(a), F.lit(b)))
    assert [join("v1//", "x"), join("/v1/", "/"), join("v1", ""), join("/v1", "/x")] == ["/v1/x", "/v1/", "/v1", "/v1/x"]


def test_compacted_json(spark):
    ask = lambda c: tuple(one(spark, explore.compacted_json(F.lit(c).cast("string"))))
    assert ask('[1, "a", [2], {"x": "WARN"}, null, 1, "z"]') == ('[1,"a",{"x":"WARN"},"z"]', 3)
    assert ask(" [ ]") == ("[]", 0) and ask("nothing") == (None, 0) and ask(None) == (None, 0)


def test_reach_and_sets(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d")], "src string, dst string")
    got = explore.affected(e, spark.createDataFrame([("a",), ("d",), ("x",), ("a",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("d", 0), ("x", 0)}
    empty = F.array().cast("array<string>")
    assert one(spark, explore.recall(empty, empty)) == 1.0 and one(spark, explore.recall(empty, F.array(F.lit("a"), F.lit("a")))) == 0.0
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "key string, at int, what string")
    assert [explore.one_of_each(rows, ["key"], "at", last).first()["what"] for last in (False, True)] == ["early", "late"]


def test_without_the_training_operators(tmp_path):
    """The entry still imports when that subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; s = __import__('pyspark').sql.SparkSession.builder.master('local[1]').getOrCreate(); q = e.queries(); d = '/root/testdata/sf0.001'; print(q['graph_degrees'](s, d).count() * q['repo_symbols'](s, d).count() > 0, any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin"})
    assert said.stdout.split()[-3:] == ["True", "False", "True"], said.stderr
