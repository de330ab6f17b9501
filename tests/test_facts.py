"""Drawing of symbols and imports, the fact store, and facts by content."""

import pytest
from pyspark.sql import functions as F

from sparloom.operators import facts, repo


def drawn(spark, path, content):
    f = spark.createDataFrame([(path, content)], "path string, content string")
    return {(r["kind"], r["name"], r["line"]) for r in repo.symbols(f).collect()}, {(r["line"], r["specifier"]) for r in repo.import_drafts(f).collect()}


def test_script(spark):
    text = """import a, {
  one,
  two as three
} from './a';
import './b'; const c = require('c');
export { x } from "../d";
export const go = (x) => x; let y = 1; var z = 2;
export const ask = async x => x;
const later = () => { class Inner {} };
export default async function main() {}
export abstract class Big {}
interface I { a: string }
export type T = 'import';
export const word = 'from nowhere';"""
    names, imports = drawn(spark, "src/x.ts", text)
    assert names == {("constant", "c", 5), ("function", "go", 7), ("constant", "y", 7), ("constant", "z", 7), ("function", "ask", 8), ("function", "later", 9), ("class", "Inner", 9), ("function", "main", 10), ("class", "Big", 11), ("interface", "I", 12), ("type", "T", 13), ("constant", "word", 14)}
    assert imports >= {(1, "./a"), (5, "./b"), (5, "c"), (6, "../d")} and all(s != "from nowhere" for _, s in imports)


def test_other_languages(spark):
    assert drawn(spark, "pkg/a/b.py", "from . import x\nfrom ..p.q import y\nimport os\nLIMIT = 3\nasync def f():\n    def inner(): pass\nclass K:\n") == ({("constant", "LIMIT", 4), ("function", "f", 5), ("class", "K", 7)}, {(1, "./"), (2, "../p/q")})
    assert drawn(spark, "src/net/m.rs", "use crate::core::io;\npub mod low;\npub(crate) async fn go() {}\nstruct S;\nenum E {}\ntrait T {}\npub const N: u8 = 1;") == (
        {("function", "go", 3), ("class", "S", 4), ("type", "E", 5), ("interface", "T", 6), ("constant", "N", 7)}, {(1, "./../../src/core/io"), (2, "./low")})
    assert drawn(spark, "A.cs", "public sealed class A : B {\n  public static async Task<int> Run(int a) {\n  internal record R(int x);\n  private interface IQ {}") == ({("class", "A", 1), ("function", "Run", 2), ("type", "R", 3), ("interface", "IQ", 4)}, set())
    assert drawn(spark, "d/x.md", "# A `b` _c_\ntext [l](y.md#z) and [m](../n.ts)\n####### no") == ({("section", "A b c", 1)}, {(2, "y.md"), (2, "../n.ts")})
    assert drawn(spark, "x.ts", "") == drawn(spark, "x.ts", None) == drawn(spark, "noext", "class A {}") == (set(), set())


def test_resolved_and_called(spark):
    f = spark.createDataFrame([
        ("src/a.ts", "import {\n go,\n type Way,\n} from './b';\nfunction start() {\n  go(1);\n}"), ("src/b.ts", "export const go = (x) => {\n  return deep(x);\n};\nfunction deep(x) {}\nexport type Way = 1;"),
        ("pkg/a/b.py", "from ..p.q import y"), ("pkg/p/q.py", "def y():\n    pass"), ("src/net/m.rs", "use crate::core::io;"), ("src/core/io/mod.rs", "fn io() {}"),
    ], "path string, content string")
    found, drafts = repo.symbols(f), repo.import_drafts(f)
    assert {(r["path"], r["target"]) for r in repo.resolved_imports(drafts, f).collect()} == {("src/a.ts", "src/b.ts"), ("pkg/a/b.py", "pkg/p/q.py"), ("src/net/m.rs", "src/core/io/mod.rs")}
    assert {(r["caller"], r["callee"]) for r in repo.calls(f, found).collect()} == {("src/a.ts#start:5", "src/b.ts#go:1"), ("src/b.ts#go:1", "src/b.ts#deep:4")}
    assert {(r["src"], r["dst"], r["line"]) for r in repo.references(drafts, f, found).collect()} == {("src/a.ts", "src/b.ts#go:1", 1), ("src/a.ts", "src/b.ts#Way:5", 1)}


@pytest.fixture()
def graph(spark):
    nodes = spark.range(900).select(F.format_string("n%04d", "id").alias("node"), F.lit("file").alias("kind"))
    edges = spark.range(700).select(F.format_string("n%04d", F.col("id") % 90).alias("src"), F.format_string("n%04d", "id").alias("dst"), F.lit("imports").alias("kind"), F.col("id").alias("line"), F.lit(1.0).alias("confidence"))
    return nodes, edges


def test_store(spark, graph, tmp_path, monkeypatch):
    monkeypatch.setattr(facts, "PAGE_FILE", 100)
    nodes, edges = graph
    place = str(tmp_path / "store")
    assert facts.page(spark, place, "a")[1] is None and facts.page(spark, place, "a")[0].count() == 0
    facts.write(nodes, edges, place, "a", "f")
    files = set(spark.read.parquet(f"{place}/rows").inputFiles())
    facts.write(nodes.limit(0), edges.limit(0), place, "b", "f")
    facts.write(nodes.limit(3), edges.limit(0), place, "b", "g")
    now = set(spark.read.parquet(f"{place}/rows").inputFiles())
    assert {f for f in now if "repo_root=a" in f} == files  # the other root is as it was
    assert {r["repo_root"]: (r["fingerprint"], r["nodes"], r["edges"]) for r in facts.roots(spark, place).collect()} == {"a": ("f", 900, 700), "b": ("g", 3, 0)}
    rows, cursor = [], 0
    while cursor is not None:
        part, cursor = facts.page(spark, place, "a", cursor, 333)
        rows += sorted(part.collect(), key=lambda r: r["nth"])
    assert [r["nth"] for r in rows] == list(range(1600))
    assert [r["node"] for r in rows[:900]] == [f"n{k:04}" for k in range(900)]
    assert [(r["src"], r["dst"]) for r in rows[900:]] == sorted((f"n{k % 90:04}", f"n{k:04}") for k in range(700))
    # a page reads the rows of its own files, none of earlier pages
    part, _ = facts.page(spark, place, "a", 1200, 50)
    assert {f.split("/")[-1] for f in {r["f"] for r in part.select(F.input_file_name().alias("f")).distinct().collect()}} != set() and "GreaterThanOrEqual(nth,1200)" in part._jdf.queryExecution().executedPlan().toString()
    spans = [tuple(r) for r in spark.read.parquet(f"{place}/rows").where("repo_root = 'a'").groupBy(F.input_file_name()).agg(F.min("nth"), F.max("nth")).collect()]
    assert len(spans) >= 16 and all(z - a < 100 for _, a, z in spans)


def test_by_content(spark, tmp_path):
    f = spark.createDataFrame([(f"src/m{k}.ts", f"function f{k % 10}() {{}}") for k in range(30)] + [("x.py", "def f0():"), ("e.ts", None)], "path string, content string")
    draw = lambda x: repo.symbols(x).select("path", "kind", "name", "line")
    whole = lambda x: {tuple(r) for r in draw(x).collect()}
    place = str(tmp_path / "kept")
    got, new = facts.by_content(f, place, "symbols", draw)
    assert new.count() == 12 and {tuple(r) for r in got.select("path", "kind", "name", "line").collect()} == whole(f)
    later = f.where("path <> 'x.py'").withColumn("content", F.when(F.col("path") == "src/m3.ts", "class New {}").otherwise(F.col("content")))
    got, new = facts.by_content(later, place, "symbols", draw)
    assert new.count() == 1 and {tuple(r) for r in got.select("path", "kind", "name", "line").collect()} == whole(later)
    # facts of a run that did not come to its keys don't count
    broken = lambda x: draw(x).withColumn("line", F.raise_error(F.lit("stopped")).cast("long"))
    more = later.unionByName(spark.createDataFrame([("q.ts", "class Q {}")], f.schema))
    with pytest.raises(Exception, match="stopped"):
        facts.by_content(more, place, "symbols", broken)
    got, new = facts.by_content(more, place, "symbols", draw)
    assert new.count() == 1 and {tuple(r) for r in got.select("path", "kind", "name", "line").collect()} == whole(more)


def test_put(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("", 4)], "content string, id int")
    place = str(tmp_path / "records")
    assert {(r["content"], r["id"]) for r in facts.put(rows, place, "id").collect()} == {("a", 1), ("b", 3), ("", 4)}
    assert {r["content"] for r in facts.put(rows.unionByName(spark.createDataFrame([("c", 9)], rows.schema)), place, "id").collect()} == {"c"}
