"""Secret scans through a trigram inverted index.

For each rule's regular expression a Boolean query over byte trigrams is derived from the parsed
pattern: literals give the trigrams that they hold, a concatenation the conjunction, a branch the
disjunction of what its parts need. A block of texts gets an inverted index (trigram -> sorted
rows of the block) for the trigrams that any query names; the postings are intersected and united
as the query says, and the rule's expression verifies the rows that are left. A rule without a
mandatory trigram scans every row.

Cases: null and empty texts hold nothing; a row's spans don't depend on other rows, so repeated
rows give repeated results; matches of one rule never overlap, those of two rules may. Input
columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import column_bytes, lean, row_chunks, tuned

#: A query: True (any row), a trigram, or ("and" | "or", queries).
Query = object
#: Exact string sets of more strings than this are given up for what they need.
MAX_STRINGS = 32


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _both(kind: str, parts: list[Query]) -> Query:
    """A conjunction or disjunction, simplified."""
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat: list[Query] = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else (p,):
            if q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _needs(text: str) -> Query:
    """What a row that holds this literal must have."""
    raw = _lower(text).encode()
    return _both("and", [raw[k : k + 3] for k in range(len(raw) - 2)])


def derive(pattern: str) -> Query:
    """The Boolean trigram query that every match of the pattern satisfies, in lower case."""
    import re._parser as sre

    def close(texts: list[str] | None, rest: Query) -> Query:
        return rest if texts is None else _both("and", [rest, _both("or", [_needs(t) for t in texts])])

    def walk(items) -> tuple[list[str] | None, Query]:
        """The exact strings of a sequence (None: not finite) and what else it needs."""
        texts: list[str] | None = [""]
        needs: list[Query] = []
        exact = True
        for op, arg in items:
            name = str(op)
            got: tuple[list[str] | None, Query] = (None, True)
            if name == "LITERAL":
                got = ([chr(arg)], True)
            elif name == "IN":
                kinds = [(str(k), v) for k, v in arg]
                if all(k == "LITERAL" for k, _ in kinds) and len(kinds) <= 4:
                    got = (sorted({_lower(chr(v)) for _, v in kinds}), True)
            elif name == "SUBPATTERN":
                got = walk(arg[3])
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                if all(t is not None and q is True for t, q in parts):
                    got = ([t for ts, _ in parts for t in ts], True)
                else:
                    got = (None, _both("or", [close(t, q) for t, q in parts]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                inner = walk(body)
                if (low, high) == (0, 1) and inner[0] is not None and inner[1] is True:
                    got = (["", *inner[0]], True)
                elif low:
                    got = (None, close(*inner))
            elif name == "AT":
                got = ([""], True)
            if got[1] is not True:
                needs.append(got[1])
            if got[0] is not None and texts is not None and len(texts) * len(got[0]) <= MAX_STRINGS:
                texts = [a + b for a in texts for b in got[0]]
            else:  # what has gathered so far ends here
                needs.append(close(texts, True))
                exact = False
                texts = got[0]
                if texts is None:
                    texts = [""]
        if exact and not needs:
            return texts, True
        needs.append(close(texts, True))
        return None, _both("and", needs)

    return close(*walk(sre.parse(pattern)))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: Whether a match counts.
    holds: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", holds=lambda m: len(m[0]) >= 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", True),
    Rule("urlauth", r"://[A-Za-z0-9._-]+:[^\s:@/]{6,}@"),
)
RULES = BASE_RULES + MORE_RULES


class Index:
    """Derives the rules' queries once; indexes blocks of texts for them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, r.compiled(), derive(r.pattern)) for r in rules]
        named: set[bytes] = set()

        def gather(q: Query) -> None:
            if isinstance(q, bytes):
                named.add(q)
            elif isinstance(q, tuple):
                for p in q[1]:
                    gather(p)

        for _, _, q in self.rules:
            gather(q)
        self.grams = sorted(named)
        #: By code of three bytes, in either case: 1 + the trigram's number.
        self.table = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
        for k, g in enumerate(self.grams):
            cases = [{c, c - 32} if 97 <= c <= 122 else {c} for c in g]
            for a in cases[0]:
                for b in cases[1]:
                    for c in cases[2]:
                        self.table[a << 16 | b << 8 | c] = k + 1

    def postings(self, data: np.ndarray, offs: np.ndarray) -> dict[bytes, np.ndarray]:
        """Rows of each named trigram, sorted."""
        if len(data) < 3:
            return {}
        x = data.astype(np.uint32)
        code = self.table[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
        at = np.flatnonzero(code)
        row = np.searchsorted(offs[1:], at, "right")
        inside = at + 3 <= offs[1:][row]
        pairs = np.unique(code[at][inside].astype(np.int64) * len(offs) + row[inside])
        gram, row = pairs // len(offs) - 1, pairs % len(offs)
        return {g: row[a:b] for g, a, b in zip(self.grams, np.searchsorted(gram, range(len(self.grams))), np.searchsorted(gram, range(len(self.grams)), "right"))}

    def rows(self, q: Query, posts: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        """The rows that satisfy a query."""
        if q is True:
            return np.arange(n)
        if isinstance(q, bytes):
            return posts.get(q, np.zeros(0, np.int64))
        parts = sorted((self.rows(p, posts, n) for p in q[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, col: pa.Array) -> Iterator[tuple[int, int, dict[int, list[tuple[int, int, int]]]]]:
        """(first row, end row, {row: [(start, rule number, end)]}) of blocks of a column; code points."""
        data, offs = column_bytes(col)
        for lo, hi in row_chunks(offs):
            o = offs[lo : hi + 1] - offs[lo]
            block = data[offs[lo] : offs[hi]]
            posts = self.postings(block, o)
            found: dict[int, list[tuple[int, int, int]]] = {}
            texts: dict[int, str] = {}
            whole = None
            for number, (rule, regex, q) in enumerate(self.rules):
                if q is True:
                    # every row is scanned; the expression first runs over the block's bytes, and
                    # rows without a match there (also one across two rows) can't have one
                    whole = block.tobytes() if whole is None else whole
                    starts = [m.start() for m in re.compile(rule.pattern.encode(), regex.flags & re.IGNORECASE).finditer(whole)]
                    ends = [m.end() - 1 for m in re.compile(rule.pattern.encode(), regex.flags & re.IGNORECASE).finditer(whole)] if starts else []
                    first, last = np.searchsorted(o[1:], starts, "right"), np.searchsorted(o[1:], ends, "right")
                    rows = sorted({k for a, b in zip(first.tolist(), last.tolist()) for k in range(a, b + 1)})
                else:
                    rows = self.rows(q, posts, hi - lo).tolist()
                for k in rows:
                    if k not in texts:
                        texts[k] = block[o[k] : o[k + 1]].tobytes().decode("utf-8", "replace")
                    for m in regex.finditer(texts[k]):
                        if rule.holds is None or rule.holds(m):
                            found.setdefault(k, []).append((m.start(), number, m.end()))
            yield lo, hi, {k: sorted(v) for k, v in found.items()}


_indexes: dict[tuple[str, ...], Index] = {}


def index_of(kinds: tuple[str, ...]) -> Index:
    """One index for each set of rules in a worker."""
    if kinds not in _indexes:
        _indexes[kinds] = Index(tuple(r for r in RULES if r.kind in kinds))
    return _indexes[kinds]


ALL_KINDS = tuple(r.kind for r in RULES)
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """One row per document: id, spans (array of kind, start, end; code points, end exclusive),
    by start and then kind as listed. Nothing is shuffled."""
    tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(kinds)
        names = [r.kind for r, _, _ in index.rules]
        for b in batches:
            for lo, hi, found in index.scan(b.column(1)):
                spans = [[{"kind": names[n], "start": s, "end": e} for s, n, e in found.get(k, ())] for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, pa.list_(span))], ["id", "spans"])

    return source.mapInArrow(lean(scan), f"id {dict(source.dtypes)['id']}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, kinds: tuple[str, ...] = ALL_KINDS, mark: str = "[SECRET:{}]") -> DataFrame:
    """The documents with every span, overlapping ones together, replaced by a mark with its first
    kind; length_col, if given, gets the new length in code points. Nothing is shuffled."""
    tuned(docs.sparkSession)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(kinds)
        names = [r.kind for r, _, _ in index.rules]
        for b in batches:
            col = b.column(at)
            changed: dict[int, str] = {}
            for lo, _, found in index.scan(col):
                for k, spans in found.items():
                    text, out, end = col[lo + k].as_py(), [], 0
                    last = -1
                    for s, n, e in spans:
                        if s >= last:
                            out += [text[end:s], mark.format(names[n])]
                        last = end = max(last, e)
                    changed[lo + k] = "".join([*out, text[end:]])
            if not changed:
                yield b
                continue
            cols = list(b.columns)
            texts = col.to_pylist()
            for k, v in changed.items():
                texts[k] = v
            cols[at] = pa.array(texts, col.type)
            if size is not None:
                lengths = cols[size].to_pylist()
                for k, v in changed.items():
                    lengths[k] = len(v)
                cols[size] = pa.array(lengths, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(lean(scan), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document against all rules."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def plain(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The same spans with every rule run over the whole text; for checks."""
    return sorted((m.start(), n, m.end()) for n, r in enumerate(rules) for m in r.compiled().finditer(text or "") if r.holds is None or r.holds(m))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
