"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an excerpt.
EXCERPT = 160


def index_tokens(c: Column) -> Column:
    """Lower-case tokens of [a-z0-9_$], duplicates kept."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9_$]+"), lambda x: x != "")


def stem(x: Column) -> Column:
    """ies -> y, ing and s off, for words long enough."""
    n = F.length(x)
    return (
        F.when(x.endswith("ies") & (n > 4), F.concat(F.substring(x, 1, n - 3), F.lit("y")))
        .when(x.endswith("ing") & (n > 5), F.substring(x, 1, n - 3))
        .when(x.endswith("s") & (n > 3), F.substring(x, 1, n - 1))
        .otherwise(x)
    )


def semantic_tokens(c: Column) -> Column:
    """Distinct sorted stems of [a-z0-9] tokens longer than one character."""
    words = F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: F.length(x) > 1)
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def identifier_tokens(c: Column) -> Column:
    """Distinct identifiers of three characters at least."""
    return F.array_distinct(F.filter(F.split(c, r"[^A-Za-z0-9_$]+"), lambda x: (F.length(x) >= 3) & x.rlike("^[A-Za-z_$]")))


def one_line(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def excerpt(c: Column, size: int = EXCERPT) -> Column:
    """One line, cut to ``size`` characters with three dots."""
    x = one_line(c)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)


def phrase_score(hay: Column, phrase: str, tokens: list[str], phrase_weight: float, token_weights: list[float]) -> Column:
    """A weight if the whole phrase occurs, and one for each token that occurs; tokens may repeat."""
    hay = F.lower(hay)
    total = F.when(hay.contains(phrase), phrase_weight).otherwise(0) if phrase else F.lit(0)
    for t, w in zip(tokens, token_weights):
        total = total + F.when(hay.contains(t), w).otherwise(0)
    return total


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def complexity(c: Column) -> Column:
    """One more than the branch keywords, as whole words, and operators (TXT-16)."""
    return (F.lit(1) + F.regexp_count(c, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|[|][|]|[?]"))).cast("long")


def lines(df, text_col: str = "text"):
    """A row for each line, numbered from 1; a trailing empty line counts."""
    return df.select("*", F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line_text")).withColumn("line", (F.col("pos") + 1).cast("long")).drop("pos")


def dense_summary(c: Column, n: int = 5, size: int = 120) -> Column:
    """The first sentences as bullets."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), one_line), lambda s: s != "")
    return F.array_join(F.transform(F.slice(found, 1, n), lambda s: F.concat(F.lit("- "), F.when(F.length(s) > size, F.concat(F.substring(s, 1, size - 3), F.lit("..."))).otherwise(s))), "\n")
