"""Tag intervals and list entries against a walk over the tags of each page with a stack for each name."""

import random
import re

from marlspike.functions import markup as M
from marlspike.functions import pages as G

SCHEMA = "page_id long, url string, html string"
TAG = re.compile(M.TOKEN.removeprefix("(?is)"), re.I | re.S)


def plain(text):
    for reference, character in M.REFERENCES:
        text = text.replace(reference, character)
    return text


def walk(page):
    """Tokens of a page: [k, name, class, id, text, end]."""
    out, cut = [], list(TAG.finditer(page))
    for k, m in enumerate(cut):
        tag = m[0]
        text = page[m.end() : cut[k + 1].start() if k + 1 < len(cut) else len(page)]
        found = re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)", tag)
        silent = re.match(r"<(script|style|noscript|svg|!)", tag, re.I)
        value = lambda a: (re.search(rf"""\s{a}\s*=\s*["']([^"']*)["']""", tag, re.I) or [None, ""])[1]  # noqa: E731, B023
        out.append([k, found[1].lower() if found and not silent else "", value("class"), value("id"), plain(text), None])
    stacks: dict = {}
    for row, m in zip(out, cut):
        name = row[1]
        if not name or name in M.VOID or (m[0].endswith("/>") and not m[0].startswith("</")):
            continue
        if m[0].startswith("</"):
            if stacks.get(name):
                stacks[name].pop()[5] = row[0]
        else:
            row[5] = len(out)
            stacks.setdefault(name, []).append(row)
    return out


def random_page(rng):
    tags = ["div", "p", "li", "article", "b"]
    parts = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        parts.append(f'<{rng.choice(tags)} class="{rng.choice(["x", "card", "nav", ""])}">' if kind < 0.4 else f"</{rng.choice(tags)}>" if kind < 0.75 else rng.choice(["<br>", "<!-- <div> -->", "<script>if (a<b) '</div>'</script>", "text &amp; more", "<img src='a'/>", "a < b"]))
    return "".join(parts)


def test_intervals_equal_a_walk(spark):
    """Nested, crossing, unclosed and stray tags, comments and scripts with tags in them; and all pages of the test tables."""
    rng = random.Random(5)
    rows = [(k, "u", random_page(rng)) for k in range(150)] + [(900, "u", None), (901, "u", ""), (902, "u", "no tags")]
    rows += [(1000 + r["page_id"], "u", r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    found: dict = {}
    for r in M.elements(M.tokens(spark.createDataFrame(rows, SCHEMA))).select("page_id", "k", "name", "class", "id", "text", "end").collect():
        found.setdefault(r["page_id"], []).append(list(r)[1:])
    for i, _, page in rows:
        assert sorted(found.get(i, [])) == walk(page or ""), i


def entries(spark, *pages):
    return [r.asDict() for r in G.entries(spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], SCHEMA)).orderBy("page_id", "place").collect()]


def test_only_leaves_are_entries(spark):
    page = '<body><nav class="card"><a href="/x">Menu entry</a></nav><div class="listing"><div class="card"><div><h3>Acme <b>Ltd</b></h3></div><div class="tag">Tools</div><a href="https://twitter.com/acme">t</a><a href="/acme">more</a> Hall 4B<div>call +1 555 200 3000</div></div><div class="card">Direct &amp; Sons<a href="mailto:Info@Sons.example?x=1"></a><span class="city">Oslo</span></div><article><a href="/z">Zeta</a></article></div></body>'
    rows = entries(spark, ("https://fair.example/list", page))
    assert [r["name"] for r in rows] == ["Acme Ltd", "Direct & Sons", "Zeta"] and [r["place"] for r in rows] == [0, 1, 2]
    assert (rows[0]["link"], rows[0]["category"], rows[0]["booth"], rows[0]["phone"]) == ("https://fair.example/acme", "Tools", "4B", "+1 555 200 3000")
    assert (rows[1]["email"], rows[1]["city"], rows[2]["link"]) == ("info@sons.example", "Oslo", "https://fair.example/z")


def test_scopes(spark):
    card = lambda n, kind="card": "".join(f'<div class="{kind}"><h4>Firm {n}{i}</h4></div>' for i in range(2))
    page = f'<body>{card("a")}<section id="past">{card("b")}</section><section id="exhibitor-list">{card("c", "exhibitor-card") * 5}</section></body>'
    small = f'<body>{card("a")}<section id="exhibitor-list">{card("c", "exhibitor-card")}</section></body>'
    empty = f'<body>{card("a")}<section id="past"><p>none</p></section></body>'
    rows = entries(spark, ("https://f.example/#past", page), ("https://f.example/", page), ("https://f.example/", small), ("https://f.example/#past", empty))
    names = [sorted({r["name"] for r in rows if r["page_id"] == k}) for k in range(4)]
    assert names == [["Firm b0", "Firm b1"], ["Firm c0", "Firm c1"], ["Firm a0", "Firm a1", "Firm c0", "Firm c1"], ["Firm a0", "Firm a1"]]
    assert sum(r["page_id"] == 1 for r in rows) == 10


def test_pages_are_dealt_by_their_text(spark, monkeypatch):
    """No window deals them out again in the session's number of parts, and the parts change no entry."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    wanted = sorted(map(str, G.entries(pages).collect()))
    monkeypatch.setattr(G, "TASK_TEXT", 1 << 16)
    found = G.entries(pages)
    length = sum(len(r["html"] or "") for r in pages.collect())
    assert found.rdd.getNumPartitions() == -(-length // (1 << 16)) > 4
    assert wanted and sorted(map(str, found.collect())) == wanted
