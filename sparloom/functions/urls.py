"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that stand for an identifier.
NUMERIC = r"^[0-9]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
LONG_WITH_DIGIT = r"^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$"


def origin(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z]+://[^/?#]+)", 1))


def path_template(u: Column) -> Column:
    """The path without trailing slash, with identifiers as {id}."""
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(NUMERIC) | s.rlike(UUID) | ((F.length(s) >= 18) & s.rlike(LONG_WITH_DIGIT)), "{id}").otherwise(s)), "/")


# Names in a path and of headers whose values are secret.
SECRET_NAMES = ("token", "secret", "signature", "apikey", "api_key", "access_token")
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key")


def redacted_headers(h: Column) -> Column:
    """A map with lower-case names, and a mark for the values of secret ones (URL-02); of names that differ in case
    only the last counts."""
    secret = lambda k: k.isin(*SECRET_HEADERS) | k.contains("token") | k.contains("api-key")
    pairs = F.transform(F.map_entries(h), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), F.when(secret(e["key"]), "[REDACTED]").otherwise(e["value"]).alias("value"))))


def content_type(c: Column) -> Column:
    """What stands before the parameters, lower-cased; null if nothing (URL-03)."""
    return F.nullif(F.lower(F.trim(F.substring_index(c, ";", 1))), F.lit(""))


def is_private_address(address: Column) -> Column:
    """Addresses and names that no request may go to (URL-04)."""
    bare = F.lower(F.regexp_replace(address, r"^\[|\]$", ""))
    v4 = F.regexp_replace(bare, "^::ffff:", "")
    is4 = v4.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    a, b = (F.try_element_at(F.split(v4, r"\."), F.lit(k)).try_cast("int") for k in (1, 2))
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
    v6 = bare.isin("::", "::1") | (bare.contains(":") & bare.rlike("^(fe80:|fc|fd|ff)"))
    return F.when(is4, closed).otherwise(v6 | bare.isin("localhost", "metadata.google.internal"))


def query_keys(u: Column) -> Column:
    """Distinct sorted keys of the query."""
    q = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(q, "&"), lambda p: F.element_at(F.split(p, "="), 1)), lambda k: k != "")))


def status_class(code: Column) -> Column:
    return F.when(code.between(200, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))
