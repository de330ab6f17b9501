"""Cases in which work would grow faster than its input."""

from sparloom.operators import explore, graph, relations, repo
from sparloom.plans import repo_queries, sql_queries, stream_queries


def test_components_of_a_rising_chain(spark):
    # labels rise along the chain, so that each node's smallest neighbour is the one before
    chain = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst")
    labelled = graph.components(chain, 4)
    assert [tuple(r) for r in labelled.groupBy("component").count().collect()] == [(0, 1001)]


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repo_queries, "FILES_A_TASK", 50, raising=False)
    spark.range(1, 401).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    f = repo_queries.files(spark, str(tmp_path))
    assert f.rdd.getNumPartitions() == 8 and f.count() == 400


def test_first_kind_of_a_name_on_a_line(spark):
    rows = [("a.ts", "const f = (x) => x; type f = 1; class C {}"), ("b.md", "# A `b`"), ("c.rs", "pub struct S; fn g() {}"), ("d.txt", "class X")]
    found = repo.symbols(spark.createDataFrame(rows, "path string, content string"))
    assert {(r["path"], r["kind"], r["name"]) for r in found.collect()} == {("a.ts", "type", "f"), ("a.ts", "class", "C"), ("b.md", "section", "A b"), ("c.rs", "class", "S"), ("c.rs", "function", "g")}


def test_scored_paths_stop_where_no_further_level_counts(spark, monkeypatch):
    real, written = relations.stored, []
    monkeypatch.setattr(relations, "stored", lambda df, name: written.append(name) or real(df, name))
    rows = [("s", "g1", "extracted"), ("s", "g2", "unknown"), ("s", "h", "extracted"), ("h", "g3", "extracted"), ("g3", "g4", "extracted")]
    edges = spark.createDataFrame(rows, "src string, dst string, provenance string").selectExpr("*", "'imports' AS kind", "1.0D AS confidence")
    node = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    ask = lambda limit: [(r["goal"], r["hops"], r["score"]) for r in relations.paths(edges, node("s"), node("g1", "g2", "g3", "g4"), 3, "outbound", limit=limit).collect()]
    assert ask(1) == [("g1", 1, 1.0)] and written.count("front") == 2
    # 0.4 at one hop is less than two hops can score
    assert ask(2) == [("g1", 1, 1.0), ("g3", 2, 0.5)]
    assert ask(9) == [("g1", 1, 1.0), ("g3", 2, 0.5), ("g2", 1, 0.4), ("g4", 3, 0.3333)]


def test_days_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS event_id", "timestamp_micros(id * 1000000) AS ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        stream_queries._days(spark, str(tmp_path), f"{tmp_path}/days", 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    days = spark.read.parquet(f"{tmp_path}/days")
    assert len(days.inputFiles()) > 1 and days.count() == 4000


def test_pairs_of_lines_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sql_queries, "ROWS_A_TASK", 500, raising=False)
    near = sql_queries.QUERIES["window_nearest"](spark, "/root/testdata/sf0.001")
    assert near.rdd.getNumPartitions() >= 10


def test_symbols_leave_no_task(spark):
    f = spark.createDataFrame([("a.ts", "function f() {}")], "path string, content string")
    assert "Exchange" not in repo.symbols(f)._jdf.queryExecution().executedPlan().toString()


def test_complexity_shuffles_no_text(spark):
    text = "export function f(a) {\n  if (a && b) { g(); }\n  return 1;\n}\nclass C {\n  if (a) {}\n}\nfunction g() { return a ? 1 : 2; } function h() {}\n  while (a) {}"
    f = spark.createDataFrame([("a.ts", text)], "path string, content string")
    found = repo.symbols(f)
    got = repo.function_complexity(f, found.where("name <> 'h'"), 2)
    assert {r["id"]: r["complexity"] for r in got.collect()} == {"a.ts#f:1": 3, "a.ts#g:8": 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Sort " in x and "line_text" in x or "Window" in x and "line_text" in x]


def test_bodies_are_dealt_over_tasks(spark):
    rows, found = spark.createDataFrame([("a.ts", 2)], "path string, line long"), spark.createDataFrame([("a.ts#f:1", "a.ts", "function", 1)], "id string, path string, kind string, line long")
    inside = repo.owned(rows, found, 9)
    assert inside.rdd.getNumPartitions() == 9 and [r["id"] for r in inside.collect()] == ["a.ts#f:1"]


def test_large_rounds_broadcast_nothing(spark, monkeypatch):
    plans, real = [], graph.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(graph, "written", seen)
    monkeypatch.setattr(graph, "MERGED_EDGES", 0, raising=False)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1)], "src long, dst long")
    out = graph.strongly_connected(edges)
    assert {r["node"]: r["scc"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert not [p for p in plans if "Broadcast" in p]


def test_reach_along_a_chain_with_branches(spark):
    rows = spark.range(400).selectExpr("explode(array(struct(id AS src, id + 1 AS dst), struct(id AS src, id + 1 + id % 2 AS dst), struct(id + 1000 AS src, id AS dst), struct(400L AS src, 350L AS dst)))").selectExpr("col.*")
    got = graph.reached(rows, spark.createDataFrame([(120,)], "node long"), 2)
    assert sorted(r["node"] for r in got.collect()) == list(range(120, 402))


def test_classes_reach_any_depth(spark):
    names = [f"lib/f{k}.ts" for k in range(130)]
    files = spark.createDataFrame([(n, "x") for n in names] + [("lib/alone.ts", "x")], "path string, content string")
    edges = spark.createDataFrame([(a, b, "imports") for a, b in zip(names, names[1:])], "src string, dst string, kind string")
    one = lambda n: spark.createDataFrame([(n,)], "path string")
    got = {r["path"]: r["confidence"] for r in explore.file_classes(files, edges, one(names[0]), one("none")).collect()}
    assert {got[n] for n in names} == {0.88} and got["lib/alone.ts"] == 0.78
