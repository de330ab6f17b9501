"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanes of repository paths, first match wins, runtime otherwise.
LANES = (
    ("generated", r"(^|/)(dist|build|coverage|generated|\.next|\.turbo)(/|$)|[._-](generated|gen)\.[a-z0-9]+$"),
    ("benchmarks", r"(^|/)(benchmarks?|perf)(/|$)|^scripts/(run|validate)-benchmarks\.ts$"),
    ("fixtures", r"(^|/)(__fixtures__|fixtures?|testdata)(/|$)"),
    ("tests", r"(^|/)(tests?|__tests__)(/|$)|[._-](test|spec)\.[a-z0-9]+$"),
    ("docs", r"(^|/)docs/|\.mdx?$"),
)
# Languages by ending.
LANGUAGES = {
    "cjs": "javascript", "cs": "csharp", "csproj": "xml", "css": "css", "html": "html", "js": "javascript", "json": "json", "jsx": "javascript", "md": "markdown",
    "mdx": "markdown", "mjs": "javascript", "props": "xml", "ps1": "powershell", "py": "python", "rs": "rust", "sh": "shell", "sln": "dotnet-solution", "sql": "sql",
    "toml": "toml", "ts": "typescript", "tsx": "typescript", "txt": "text", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
# File names of tests, by language.
CHANGED_TEST = r"\.(test|spec)\.[cm]?[jt]sx?$|(_test\.go|test\.java|test\.py)$"
# What of a path makes it a surface that others use.
PUBLIC_SURFACE = (
    r"(^|/)(routes?|api|controllers?)/", r"openapi|swagger", r"(^|/)migrations?/", r"(^|/)schema/", r"(^|/)package(-lock)?\.json$", r"(^|/)(pnpm-lock\.yaml|yarn\.lock|bun\.lockb?|cargo\.toml|cargo\.lock)$",
    r"(^|/)src/(?:.*/)?index\.[cm]?[jt]sx?$", r"\.(config|conf)\.[cm]?[jt]s$",
)
# Endings of environment files that are templates.
ENV_TEMPLATES = ("example", "sample", "template", "dist", "default", "defaults")


def lane(path: Column) -> Column:
    """PTH-01."""
    out = F.lit("runtime")
    for name, pattern in reversed(LANES):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def language(path: Column) -> Column:
    """The language of a path's ending, or null (PTH-02)."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def is_test(path: Column) -> Column:
    """A test by folder or by the mark before its ending (FLT-11, as change impact has it)."""
    return path.rlike(r"(^|/)(tests?|__tests__)/|[._-](test|spec)\.[A-Za-z0-9]+$")


def is_changed_test(path: Column) -> Column:
    """A test as the review of changed tests has it (FLT-11)."""
    return path.contains("__tests__/") | path.startswith("tests/") | F.lower(path).rlike(CHANGED_TEST)


def is_docs(path: Column) -> Column:
    return F.lower(path).rlike(r"^docs/|^readme\.md$|^changelog\.md$|\.mdx?$")


def is_public_surface(path: Column) -> Column:
    """Routes, descriptions, migrations, manifests, entry and configuration files."""
    return F.lower(path).rlike("|".join(PUBLIC_SURFACE))


def env_file(path: Column) -> Column:
    """template, sensitive, or null for what is no environment file (FLT-10)."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    like = r"^\.env$|^\.env\.|\.env$"
    template = rf"(^\.env|\.env)\.({'|'.join(ENV_TEMPLATES)})$"
    return F.when(base.rlike(template), "template").when(base.rlike(like), "sensitive")


def module_root(path: Column) -> Column:
    """. for files at the top; src/x from three segments on, else the first segment."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, ".").when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 2), F.concat(F.lit("src/"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def is_under(path: Column, prefix: Column) -> Column:
    """Equal to the prefix or below it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def shard_root(path: Column) -> Column:
    """packages/x, apps/x and src/x, else the first segment; files right in src stay there."""
    parts = F.split(path, "/")
    two = F.array_join(F.slice(parts, 1, 2), "/")
    return (
        F.when(F.get(parts, F.lit(0)).isin("packages", "apps"), two)
        .when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) >= 2), F.when(F.get(parts, F.lit(1)).contains("."), "src").otherwise(two))
        .otherwise(F.get(parts, F.lit(0)))
    )


def glob_regex(pattern: str) -> str:
    """An anchored expression: ** any characters, * none of /, ? one but /; brackets are literal."""
    import re

    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k])))
        k += 1
    return f"^{''.join(out)}$"
