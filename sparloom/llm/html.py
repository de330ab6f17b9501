"""Main-text extraction by equivalence-class template deduction over pages of one host.

A token is a structural start tag with its class and id, under the path of the containers around
it, or the text of a block under such a path. Each token of a host gets an occurrence vector: how
often it occurs in each of the host's distinct pages. The vector is kept as a digest, a sum over pages
of (mixed page hash x occurrences), so that it can be added up in parts and no host's pages need to
meet in one task. Tokens with equal vectors are an equivalence class. A class makes template of its
texts if it has enough support and one of its tags (or the page itself) encloses the text: the text
then stands there whenever and as often as that tag. On each page the class's texts have to keep the
class's order, else they are no template there.

What the template leaves between its tokens are the slots. All of them are extracted but those in
containers whose role is another than main text (navigation, footer, advert, form, comments, ...), and
but blocks that are links only and stand in no container with other text. A word in a longer name
(has-sidebar) takes out no container that holds the page's main text, and a page is only empty if all
of its text is in links, or in containers of such tags, or beside an empty main text.

Cases: null or empty html gives an empty text; a null or broken url is a host of its own name; a
host with fewer than LEAST_PAGES distinct pages, a page with no token of its host's template, and a page with
nothing but template are judged by their own tokens; repeated rows are each extracted. Input columns of other names are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import stored, tuned

#: Tokens in a smaller share of a host's pages are no part of its template.
SUPPORT = 0.1
#: Nor are tokens in fewer distinct pages than this.
LEAST_PAGES = 3
#: Templates of up to so many bytes in all are handed to every task; larger ones are joined.
BROADCAST_BYTES = 32 << 20
#: Parts into which a host's pages are dealt in that join.
SALTS = 64

# Kinds of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select button video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
STRUCTURE = frozenset("html head body header footer nav aside main article section div ul ol dl table form fieldset dialog figure details menu center".split())
AWAY = frozenset("head header footer nav aside form fieldset dialog menu".split())
FORMS = frozenset("form fieldset".split())
MAIN = frozenset("article main".split())
AWAY_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN_WORDS = frozenset("article content entry main post story maincontent mainarea bodytext articlebody postbody entrycontent".split())

#: The role of containers that hold no main text, by their tag.
DROPPED = -3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def label(tag: str, attrs: str) -> str:
    """A tag with its class, id and role; numbers in them don't tell tags apart."""
    if not attrs or "=" not in attrs:
        return tag
    parts = [f"{k.lower()[0]}:{'.'.join(sorted(re.sub(r'\d+', '0', a or b or c).split()))}" for k, a, b, c in _NAMED.findall(attrs)]
    return f"{tag}|{'|'.join(sorted(parts))}" if parts else tag


@lru_cache(1 << 16)
def role(token: str) -> int:
    """1: the token opens a main text. What is none: DROPPED by its tag, -2 by a whole name, -1 by a
    word in a longer name, a name beside one of a main text, or as a form. 0: neither."""
    tag, *named = token.split("|")
    if tag in ("html", "body"):
        return 0
    if tag in AWAY and tag not in FORMS:
        return DROPPED
    names = [w for x in named for w in x[2:].split(".")]
    whole = {w.replace("-", "").replace("_", "").lower() for w in names}
    words = [{w.lower() for w in _WORD.findall(x)} | {x.replace("-", "").replace("_", "").lower()} for x in names]
    main = any(w & MAIN_WORDS and not w & AWAY_WORDS for w in words)
    if whole & AWAY_WORDS:
        return -1 if main else -2
    if tag in FORMS or (not main and any(w & AWAY_WORDS for w in words)):
        return -1
    return 1 if main or tag in MAIN else 0


def other_roles(found: list[tuple[tuple[str, ...], str, bool]]) -> tuple[Callable[[tuple[str, ...]], bool], bool]:
    """Whether a path lies in a container of another role; and whether the page has a main text's
    container outside of those. Containers of role -1 count by what is in them: one that holds a
    main text, or half of the page's unlinked text, while no main text stands outside, is none."""
    sure = {path: any(role(t) < -1 for t in path) for path, _, _ in found}
    weak: dict[tuple[str, ...], int] = {}
    total = 0
    for path, text, link in found:
        if not sure[path]:
            size = 0 if link else len(text)
            total += size
            for k, t in enumerate(path, 1):
                if role(t) == -1:
                    weak[path[:k]] = weak.get(path[:k], 0) + size
    mains = {path for path, text, _ in found if not text and not sure[path] and role(path[-1]) > 0}
    off = set(weak)
    away = lambda path: any(role(t) < -1 for t in path) or any(path[:k] in off for k in range(1, len(path) + 1))
    for p in sorted(weak, key=lambda p: (-weak[p], len(p))):
        inside = {m for m in mains if m[: len(p)] == p}
        if (inside or 2 * weak[p] >= total) and all(away(m) for m in mains - inside):
            off.remove(p)
    return away, any(not away(m) for m in mains)


def spoken(path: str, text: str) -> int:
    """A text token's number."""
    return _digest(f"{path}\n{text}") >> 1


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """(containers around, text of a block, whether it is all in links) in page order; also
    (containers, "", False) when a container opens."""
    stack: list[str] = []
    names: list[str] = []
    held: list[str] = []
    linked = plain = 0
    in_link = False
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        raw, tag = m[0], m[1]
        if tag is None:
            if raw[:2] in ("<!", "<?"):
                continue
            held.append(raw)
            n = len(raw.strip())
            linked, plain = linked + n * in_link, plain + n * (not in_link)
            continue
        tag = tag.lower()
        closing = raw[1] == "/"
        if not closing and tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end if tag in ("script", "style", "textarea") else at
            held.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            if tag in ("br", "img"):
                held.append(" ")
            continue
        if tag in ("td", "th"):
            held.append(" ")
            continue
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            yield tuple(stack), text, linked > 0 and not plain
        held, linked, plain = [], 0, 0
        if tag in STRUCTURE and tag not in VOID:
            if not closing:
                stack.append(label(tag, m[2]))
                names.append(tag)
                yield tuple(stack), "", False
            elif tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                del names[k:], stack[k:]
    text = " ".join(entities.unescape("".join(held)).split())
    if text:
        yield tuple(stack), text, linked > 0 and not plain


def host_of(url: str | None) -> str:
    """The host of a url; a null, empty or broken one is a host of its own name."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return ((m and m[1]) or url or "").lower()


def _digest(page: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(page.encode(), digest_size=8).digest(), "little")


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, said, n, high, low, at): for each host and token, the distinct pages that have
    it, the two halves of its vector's digest and the mean of its first places. said is null for a
    tag and tells texts apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: dict[tuple, list] = {("", None): [1, 0]}
                for order, (path, text, _) in enumerate(blocks(page or "")):
                    if text and any(role(t) == DROPPED for t in path):
                        continue
                    name = ">".join(path)
                    found.setdefault((name, spoken(name, text) if text else None), [0, order])[0] += 1
                host, mark = host_of(url), _digest(page or "")
                rows += [(host, p, said, mark - 2**63, ((mark * n) & (2**64 - 1)) - 2**63, at) for (p, said), (n, at) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["host", "path", "said", "page", "mark", "at"])

    marked = pages.select("url", "html").mapInArrow(scan, "host string, path string, said long, page long, mark long, at long")
    # equal pages count once, so that copies don't make template of their texts
    once = marked.groupBy("host", "path", "said", "page").agg(F.first("mark").alias("mark"), F.first("at").alias("at"))
    # two halves of the mark, so that their sums stay within a long for any number of pages below 2**31
    high, low = F.shiftright("mark", 32), F.col("mark").bitwiseAND(F.lit(2**32 - 1))
    return once.groupBy("host", "path", "said").agg(F.count("*").alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low"), F.avg("at").alias("at"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): template is the JSON list of the valid classes, each the list of its
    texts in their order. Hosts without such a class have no row."""
    seen = occurrences(pages)
    sizes = seen.where("path = '' AND said IS NULL").select("host", F.col("n").alias("pages"))
    # of a page's tokens so many are kept at most: the mean number in a page / SUPPORT
    kept = seen.where(F.col("n") >= LEAST_PAGES).join(sizes, "host").where(F.col("n") >= F.col("pages") * SUPPORT)
    classes = kept.groupBy("host", "high", "low", "n").agg(F.array_sort(F.collect_list(F.struct("at", "path", "said"))).alias("tokens"))
    mixed = F.exists("tokens", lambda t: t["said"].isNull()) & F.exists("tokens", lambda t: t["said"].isNotNull())
    hosts = classes.where(mixed).groupBy("host").agg(F.collect_list("tokens").alias("classes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[repeated([(t["path"], t["said"]) for t in c]) for c in cs] for cs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(sorted(c for c in cs if c)) for cs in made], pa.string())], ["host", "template"])

    return hosts.mapInArrow(scan, "host string, template string").where("template != '[]'")


def repeated(tokens: list[tuple[str, int | None]]) -> list[int]:
    """Of a class's tokens, in order, the texts that one of its tags encloses."""
    tags = {p for p, said in tokens if said is None}
    around = lambda p: p in tags or "" in tags or any(p.startswith(t + ">") for t in tags)
    return [said for p, said in tokens if said is not None and around(p)]


def template_blocks(found: list[tuple[tuple[str, ...], str, bool]], template: list[list[int]] | None) -> set[int]:
    """The numbers of the blocks that are template on this page."""
    if not template:
        return set()
    known = {said: (c, k) for c, texts in enumerate(template) for k, said in enumerate(texts)}
    held: dict[int, list[tuple[int, int]]] = {}
    for i, (path, text, _) in enumerate(found):
        got = known.get(spoken(">".join(path), text)) if text else None
        if got:
            held.setdefault(got[0], []).append((got[1], i))
    # one order: all texts of the class in turn, once or more often
    return {i for c, at in held.items() if [k for k, _ in at] == list(range(len(template[c]))) * (len(at) // len(template[c])) for _, i in at}


def extract(page: str | None, template: list[list[int]] | None) -> str:
    """The main text of a page: what its host's template leaves, in no container of another role."""
    found = list(blocks(page or ""))
    gone = template_blocks(found, template)
    away, main = other_roles(found)
    out: list[str] = []
    # if nothing is left: words in names don't count; then, template does not
    for dropped, words in ((gone, True), (gone, False), (set(), True), (set(), False)):
        if out or (not words and main):
            continue
        left = [(path, text, link) for i, (path, text, link) in enumerate(found) if text and i not in dropped and not (away(path) if words else any(role(t) == DROPPED for t in path))]
        plain = {path for path, _, link in left if not link}
        inner = {p for p in plain if p and p[-1].split("|")[0] not in ("html", "body")}
        stays = lambda p: p in plain or any(p[:k] in inner for k in range(len(p))) or any(role(t) > 0 for t in p)  # noqa: B023, E731
        out = [text for path, text, link in left if not link or stays(path)]
    return "\n\n".join(out)


def find(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    spark = pages.sparkSession
    tuned(spark)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    made = stored(templates(source), "templates")
    size = made.agg(F.sum(F.length("host") + F.length("template"))).first()[0] or 0
    kind = dict(source.dtypes)["id"]
    schema = f"id {kind}, url string, text string"
    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: json.loads(r["template"]) for r in made.collect()})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [extract(page, known.value.get(host_of(url))) for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

        return source.mapInArrow(scan, schema)

    def hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())], ["id", "url", "html", "host"])

    salted = made.select("host", "template").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = source.mapInArrow(hosted, f"id {kind}, url string, html string, host string").withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select("id", "url", "html", "template")

    def scan_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page, json.loads(t) if t else None) for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return joined.mapInArrow(scan_joined, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    found = find(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
