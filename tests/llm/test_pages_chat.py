"""Pages, conversations and the pipeline."""

import json

import pytest

from sparloom.llm import chat, html

PAGE = "<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class=\"ad\">buy</div>{open}<h1>Head {n}</h1><p><b>First&nbsp;&lt;{n}&gt;<br>line<p>Second\n  {n} <a href='>'>link</a></p><script>var t='</p>';</script><div class='comments'><p>reader says</p></div>{close}<aside>side</aside><footer>&copy; foot</footer></body></html>"


def pages():
    rows = [(k, f"https://one.example/{k}", PAGE.format(open="<article>", close="</article>", n=k)) for k in range(5)]
    rows += [(10 + k, f"http://two.example/{k}", PAGE.format(open="<div id='c1'>", close="</div>", n=f"{k} with somewhat more text {k * 7}")) for k in range(4)]
    rows += [(20, "https://alone.example/", PAGE.format(open="<main>", close="</main>", n="x")), (21, None, None), (22, "", ""), (23, "https://one.example/9", "plain text only"), (24, "https://one.example/a", "<article><p>cut off"), (0, "https://one.example/0", PAGE.format(open="<article>", close="</article>", n=0))]
    return rows


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, id string")
    got = sorted((r["id"], r["text"]) for r in html.find(df).collect())
    text = lambda n: f"Head {n}\n\nFirst <{n}> line\n\nSecond {n} link"
    want = [(k, text(k)) for k in range(5)] + [(10 + k, text(f"{k} with somewhat more text {k * 7}")) for k in range(4)] + [(20, text("x")), (21, ""), (22, ""), (23, "plain text only"), (24, "cut off"), (0, text(0))]
    assert got == sorted(want)
    assert html.find(df.limit(0)).count() == 0


def test_pages_broken_urls(spark, monkeypatch):
    """A broken url is a host of its own name, whichever way templates travel."""
    body = "<html><body><article><p>Menu text here that repeats</p><p>Unique article number {} words</p></article></body></html>"
    urls = ["http:///x", "http:///x", "http:///x", "http:///y", None, None, None, "", "no url", "HTTP://A.example/1", "http://a.EXAMPLE/2", "http://u@a.example/3"]
    df = spark.createDataFrame([(k, u, body.format(k)) for k, u in enumerate(urls)], "page_id long, url string, html string")
    found = []
    for limit in (1 << 25, 0):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        found.append({r["id"]: r["text"] for r in html.find(df).collect()})
    cut = {0, 1, 2, 4, 5, 6, 7, 9, 10, 11}  # null and empty are one name
    assert found[0] == found[1] == {k: f"Unique article number {k} words" if k in cut else f"Menu text here that repeats\n\nUnique article number {k} words" for k in range(12)}


def texts(spark, bodies, host="https://h.example/"):
    df = spark.createDataFrame([(k, f"{host}{k}", f"<html><body{b if b.startswith((' ', '>')) else '>' + b}</body></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r["text"] for r in html.find(df).orderBy("id").collect()]


def test_pages_repeated_text(spark):
    """Text that stands on every page is template, also inside an article; copies of a page make none."""
    page = "<article><p>Read on our site</p><p>story {n}</p><p>Thanks for reading</p></article>"
    assert texts(spark, [page.format(n=n) for n in range(4)]) == [f"story {n}" for n in range(4)]
    assert texts(spark, [page.format(n=1)] * 4) == ["Read on our site\n\nstory 1\n\nThanks for reading"] * 4
    # on one page the class's texts stand in another order: there they are no template
    turned = "<article><p>Thanks for reading</p><p>story 9</p><p>Read on our site</p></article>"
    assert texts(spark, [*(page.format(n=n) for n in range(4)), turned])[-1] == "Thanks for reading\n\nstory 9\n\nRead on our site"


def test_pages_several_containers(spark):
    """All containers with text of their own are kept, and those of rare layouts."""
    page = "<div class='lead'><p>lead {n}</p></div><div class='rest'><p>the much longer rest {n}</p></div><section class='more'>more {n}</section><ul><li><a href='/'>link {n}</a></li></ul>"
    want = [f"lead {n}\n\nthe much longer rest {n}\n\nmore {n}" for n in range(12)]
    assert texts(spark, [page.format(n=n) for n in range(12)]) == want
    assert texts(spark, [page.format(n=0)]) == want[:1]
    rare = "<div class='rest'><p>short</p></div><main><p>rare</p><p><a href='/'>its link</a></p></main>"
    assert texts(spark, [*(page.format(n=n) for n in range(12)), rare]) == [*want, "short\n\nrare\n\nits link"]


def test_pages_words_in_longer_names(spark):
    """One word in a class takes out no container that holds the page's text."""
    rest = "<nav>menu</nav><div class='sidebar'>side {n}</div>"
    opens = [" class='has-sidebar'><div>{}</div>", "<form action='/'><div>{}</div></form>", "<div class='page with-widget'><div>{}</div></div>", "<article class='post comments-open'>{}</article>", "<div class='content share-enabled'>{}</div>", "<div class='ads'>{}</div>"]
    for body in opens:
        pages = [(body.format(f"<p>a story of some length {n}</p>") + rest.format(n=n)) for n in range(4)]
        got = texts(spark, pages)
        assert got == [f"a story of some length {n}" + (f"\n\nside {n}" if "'ads'" in body else "") for n in range(4)]
    # beside a main text, words still take out what is longer than it
    page = "<article class='post'>story {n}</article><div class='post-comments'><article class='comment'>a reader says very much {n}</article><p>another one, too {n}</p></div><section class='related-posts'><article class='post'>tease {n}</article></section>"
    assert texts(spark, [page.format(n=n) for n in range(4)]) == [f"story {n}" for n in range(4)]
    assert texts(spark, ["<article></article><div class='ad'>buy 1</div>"]) == [""]


HARD = ["<s>", "</\\s>", "[INST]x[\\INST]", "<", "[", "a<</s>", "[ROLE]\\", "[/ROLE]<s", "\\</s>", "", None, "\n"]


def test_round_trip(spark):
    rows = [(i, i % 3 if i % 5 else None, b, c) for i, (b, c) in enumerate((x, y) for x in HARD for y in HARD)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, id int")
    back = chat.read_back(chat.render(chat.canonical(df, "conv_id"))).collect()
    assert {r["id"]: [tuple(t) for t in r["turns"]] for r in back} == {i: [(b or "", c or "")] for i, _, b, c in rows}


def test_loss_and_order(spark):
    rows = [(1, 1, "assistant", "B</s>"), (1, 0, "user", "A"), (1, 2, "assistant", "[INST]é"), (1, 1, "assistant", "B</s>"), (2, 0, "assistant", None), (None, 0, "gpt", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["id"]: r for r in chat.read_back(chat.render(chat.canonical(df, "conv_id"))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ["A", "B</s>", "B</s>", "[INST]é"]
    assert got[1]["loss_texts"] == ["B</s>", "B</s>", "[INST]é"] and got[2]["loss_texts"] == [""]
    # roles of turn rows stay as they are
    assert [tuple(t) for t in got[None]["turns"]] == [("gpt", "n")] and got[None]["loss_texts"] == []
    assert chat.render(chat.canonical(df.limit(0), "conv_id")).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "x": 3}, "exchange", [("user", "hi"), ("assistant", "yo")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "c"}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"zzz": 1}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(98, "no json"), (99, None)], "i long, j string")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_json(df, "i", "j").collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(records)} | {98: (None, []), 99: (None, [])}
    typed = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)], "z"), (2, None, "z")], "id long, conversations array<struct<from:string,value:string>>, extra string")
    assert {r["id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical(typed, "id").collect()} == {1: [("user", "hi"), ("assistant", "")], 2: []}
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1,)], "q int").schema)
