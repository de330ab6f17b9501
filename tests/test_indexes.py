"""Stored indexes: swapping, pruning, phrases, refresh of shards."""

import pytest
from pyspark.sql import functions as F

from sparloom.operators import fulltext, repo, shards
from sparloom.sources import versions


@pytest.fixture(scope="module")
def source(spark):
    rows = [
        ("src/core/a.ts", "typescript", "export function openDoor(a) {\n  return lock_door(a);\n}"), ("src/core/b.ts", "typescript", "const lock = 1;\n// door lock\nconst lock_doors = 2;"),
        ("tests/a.test.ts", "typescript", "test('door', () => {});"), ("docs/x.md", "markdown", "# Doors\nA 100% door_lock and Door-Lock"), ("lib/none.py", "python", None), ("lib/empty.py", None, ""),
    ]
    return spark.createDataFrame(rows, "path string, language string, content string")


def hits(df):
    return {(r["kind"], r["path"], r["line"]) for r in df.collect()}


def test_whole_tokens_and_phrases(spark, source, tmp_path):
    place = f"{tmp_path}/index"
    fulltext.build(source, repo.symbols(source), place)
    ask = lambda q, **k: hits(fulltext.search(spark, place, q, limit=50, **k))
    # whole words only: doors is no door; one file's other lines then count as they contain it
    assert {p for _, p, _ in ask("door")} == {"src/core/a.ts", "src/core/b.ts", "tests/a.test.ts", "docs/x.md"}
    assert {p for _, p, _ in ask("doors")} == {"src/core/b.ts", "docs/x.md"}
    # a token of several words asks for them side by side, in this order
    assert {p for _, p, _ in ask("door_lock")} == {"docs/x.md"}
    assert {p for _, p, _ in ask("lock_door")} == {"src/core/a.ts"}
    assert {p for _, p, _ in ask("lock_door", mode="like")} == {"src/core/a.ts", "src/core/b.ts"}
    assert ask("door", lanes=["tests"]) == {("file", "tests/a.test.ts", 1)}
    assert ask("", mode="fts") == ask("?!") == ask("door", lanes=[]) == set()
    best = fulltext.search(spark, place, "openDoor", limit=1).first()
    assert (best["kind"], best["title"], best["score"]) == ("symbol", "function openDoor", 8 + 16 + 24 + 5)


def test_reads_its_buckets_only(spark, source, tmp_path):
    place = f"{tmp_path}/index"
    fulltext.build(source, repo.symbols(source), place, buckets=16)
    some = fulltext.candidates(spark, place, "door lock")
    want = {fulltext.bucket_of(w, 16) for w in ("door", "lock")}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in some.inputFiles()} > want  # before pruning
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(token" in plan
    rows = versions.opened(spark, place, "postings").where(F.col("bucket").isin(sorted(want)))
    assert {r["bucket"] for r in rows.select("bucket").distinct().collect()} == want
    assert rows.where(F.pmod(F.crc32("token"), F.lit(16)) != F.col("bucket")).count() == 0


def test_failed_write_changes_nothing(spark, source, tmp_path):
    place = f"{tmp_path}/index"
    assert versions.current(spark, place) is None and not fulltext.status(spark, place).first()["present"]
    first = fulltext.build(source, repo.symbols(source), place, built_at="1")

    def broken(folder):
        source.write.parquet(f"{folder}/files")
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        versions.publish(spark, place, broken)
    assert versions.current(spark, place) == first and fulltext.status(spark, place, source).first()["fresh"]
    second = fulltext.build(source.where("path <> 'docs/x.md'"), repo.symbols(source), place)
    assert versions.current(spark, place) == second and not fulltext.status(spark, place, source).first()["fresh"]
    fulltext.build(source, repo.symbols(source), place)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{first}/files")


def test_shards_equal_a_full_rebuild(spark, source, tmp_path):
    later = source.where("path <> 'lib/none.py'").withColumn("content", F.when(F.col("path") == "src/core/a.ts", F.lit("export function shut() {}")).otherwise(F.col("content")))
    later = later.where("path NOT LIKE 'docs/%'").unionByName(spark.createDataFrame([("apps/web/m.ts", "typescript", "const door = 1;")], source.schema))
    facts = lambda f: (f, repo.symbols(f), repo.fact_graph(f)[1])
    bit, whole = f"{tmp_path}/bit", f"{tmp_path}/whole"
    assert {r["step"] for r in shards.refresh(*facts(source), bit).collect()} == {"added"}
    steps = {r["shard"]: r["step"] for r in shards.refresh(*facts(later), bit).collect()}
    assert steps == {"src/core": "rewritten", "tests": "kept", "docs": "removed", "lib": "rewritten", "apps/web": "added"}
    shards.refresh(*facts(later), whole)
    drop = lambda df: sorted(map(str, df.drop("refresh").select(sorted(set(df.columns) - {"refresh"})).collect()))
    for name in ("files", "symbols", "edges"):
        assert drop(shards.opened(spark, bit, name)) == drop(shards.opened(spark, whole, name))
    assert drop(shards.manifest(spark, bit)) == drop(shards.manifest(spark, whole))
    # what is kept lies where it lay
    refreshes = {r["shard"]: r["refresh"] for r in shards.manifest(spark, bit).collect()}
    assert refreshes["tests"] != refreshes["lib"] == refreshes["src/core"]
    assert shards.refresh(*facts(later), bit).where("step <> 'kept'").count() == 0
    assert hits(shards.search(spark, bit, "door")) == hits(shards.search(spark, whole, "door"))
    assert {p for _, p, _ in hits(shards.search(spark, bit, "door"))} == {"apps/web/m.ts", "src/core/b.ts", "tests/a.test.ts"}
    assert hits(shards.search(spark, bit, "door", ["tests"])) == {("file", "tests/a.test.ts", 1)}


def test_ladder(spark, source, tmp_path):
    index, split, found = f"{tmp_path}/index", f"{tmp_path}/split", repo.symbols(source)
    mode = lambda **k: {r["retrieval_mode"] for r in shards.retrieve(spark, "door", index, split, **k).collect()}
    whole = (fulltext.prepared(source, found), fulltext.symbol_rows(found))
    assert mode() == set() and mode(full=whole) == {"full"} and mode(full=whole, require_fresh=True, now=source) == set()
    shards.refresh(source, found, repo.fact_graph(source)[1], split)
    assert mode(full=whole) == {"manifest"}
    fulltext.build(source, found, index, full_text=False)
    assert mode() == {"like"}
    fulltext.build(source, found, index)
    assert mode(require_fresh=True, now=source) == {"fts"} and mode(require_fresh=True, now=source.limit(2)) == set()
