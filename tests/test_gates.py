"""Claims of documents and the gate's decision on small inputs."""

import pytest

from sparloom.operators import gates

GUIDE = """# Guide
[ok](a.md "title"), [up](../src/x.ts#L3), [root](/src/x.ts?raw), [gone](b.md), [out](../../y), [mail](mailto:a@b.example), [own](#part) and [bad](/src/none.ts)
Run `npm run build`, then pnpm run e2e:fast. Not npm install.
Dependencies: react, "left-pad", @scope/x: later
dependency none here
Tables: Orders; parts, 9x
"""


def rows(df):
    return {(r["kind"], r["subject"], r["line"]) for r in df.collect()}


def test_conflicts(spark):
    files = spark.createDataFrame([("docs/g.md", GUIDE), ("docs/a.md", None), ("src/x.ts", "[no](doc.md) npm run none")], "path string, content string")
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    links = {("link", "docs/g.md -> docs/b.md", 2), ("link", "docs/g.md -> src/none.ts", 2)}
    assert rows(gates.source_conflicts(files)) == links
    artifacts = spark.createDataFrame([("dist/a.json", "1"), ("dist/b.json", "2"), ("dist/c.json", None)], "path string, fingerprint string")
    got = rows(gates.source_conflicts(files, name("build"), name("react"), name("orders"), artifacts, "2"))
    assert got == links | {("script", "script:e2e:fast", 3), ("dependency", "dependency:left-pad", 4), ("dependency", "dependency:@scope/x", 4), ("table", "table:parts", 6), ("artifact", "dist/a.json#indexFingerprint", None)}
    # facts that there aren't any of contradict nothing
    assert rows(gates.source_conflicts(files, name("build").limit(0), name("react").limit(0), name("orders").limit(0))) == links
    assert gates.source_conflicts(files.limit(0), name("a")).count() == 0


@pytest.mark.parametrize("enforce", [True, False])
def test_decision(spark, enforce):
    conflicts = spark.createDataFrame([("link", "s1", "warning"), ("link", "s1", "warning"), ("artifact", "s2", "stale"), ("x", "s3", "blocking")], "kind string, subject string, severity string")
    health = spark.createDataFrame([("a", "fresh"), ("b", "stale"), ("c", "degraded"), ("d", "missing")], "source string, status string")
    claims = spark.createDataFrame([(1, "change_safe", "conflicted"), (2, "note", "conflicted"), (3, "change_safe", "supported")], "claim_id long, kind string, status string")
    out = gates.signals(conflicts, health, claims=claims, enforce=enforce)
    level = "block" if enforce else "warn"
    assert {tuple(r) for r in out.collect()} == {
        ("source-conflict:needs-review", "warn", "s1"), ("source-conflict:stale-generated-artifact", level, "s2"), ("source-conflict:blocking", "block", "s3"), ("index-health:stale", level, "b"), ("index-health:degraded", "warn", "c"),
        ("index-health:missing", level, "d"), ("claim-ledger:conflicted", level, "1"), ("claim-ledger:conflicted", "warn", "2"),
    }
    assert tuple(gates.decision(out).first())[:3] == ((False, 3, 5) if enforce else (False, 7, 1))
    assert tuple(gates.decision(out.where("severity = 'warn'")).first())[0] and tuple(gates.decision(out.limit(0)).first()) == (True, 0, 0, "")
    with pytest.raises(ValueError):
        gates.signals()
