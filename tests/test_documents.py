"""Golden vectors of uploads, pages, templates and exports, and the queries that have no SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlspike import catalog
from marlspike.functions import pages as G
from marlspike.functions import templates as T
from marlspike.sources import exports as E
from marlspike.sources import files as S

SF = "/root/testdata/sf0.001"


def sources(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "source_id long, content string")


def one(spark, column):
    return spark.range(1).select(column.alias("y")).first()["y"]


def test_delimited_upload(spark):
    text = 'Organization,Contact Person,Designation,Work Email,Telephone,HQ City,Website\n"Acme, Inc",Ann,Head,a@acme.org,123 456 7890,Oslo,acme.org\n\nBeta,Bo,,,,,\n'
    rows = S.table_rows(sources(spark, text, "", None)).orderBy("row_number").collect()
    assert [(r["row_number"], r["company"], r["contact"], r["title"], r["email"], r["phone"], r["city"], r["parse_status"]) for r in rows] == [
        (2, "Acme, Inc", "Ann", "Head", "a@acme.org", "123 456 7890", "Oslo", "PARSED"),
        (3, "Beta", "Bo", None, None, None, None, "PARSED"),
    ]


def test_pasted(spark):
    table = "Company\tContact\tEmail\tPhone\nA\tB\ta@b.co\t1\nC\tD\tc@d.co\t2"
    lines = "Acme | call +1 555 234 5678\nnothing here"
    rows = S.pasted_rows(sources(spark, table, lines)).orderBy("source_id", "row_number").collect()
    assert [(r["source_id"], r["company"], r["email"], r["parse_status"]) for r in rows] == [(0, "A", "a@b.co", "PARSED"), (0, "C", "c@d.co", "PARSED"), (1, "Acme", None, "PARSED"), (1, None, None, "FAILED")]
    assert rows[2]["phone"] == "+1 555 234 5678"


def test_json_payloads(spark):
    deep = '{"response": {"data": {"members": [{"name": "Acme", "phone": "1"}, {"name": "Beta"}]}}}'
    listing = '[{"companyName": "Home"}, {"companyName": "1. APPAREL & FASHION"}, {"company_name": "Floor plan"}, {"companyName": "Real", "mail": "Exhibition@x.org"}]'
    rows = S.record_leads(S.json_records(sources(spark, deep, listing, "[1]", "no json", None))).collect()
    assert {(r["source_id"], r["company"], r["email"]) for r in rows} == {(0, "Acme", None), (1, "Real", None)}


def test_json_records_equal_a_walk(spark):
    """Lists under keys and wrappers, nested, mixed and too deep, against a walk over the parsed payload."""
    rng = random.Random(5)
    names = [*S.RECORD_KEYS[:4], *S.WRAPPERS, "other"]

    def payload(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.2:
            return rng.choice([None, 1, "x", True, [], [1], {}])
        if kind < 0.45:
            return [{"n": rng.randrange(100)} for _ in range(rng.randrange(4))]
        return {key: payload(depth + 1) for key in rng.sample(names, rng.randrange(1, 5))}

    def walk(node, depth=0):
        if isinstance(node, list):
            return node if len(node) >= 2 else None
        if depth > S.MOST_WRAPPERS or not isinstance(node, dict):
            return None
        lists = [node[k] for k in S.RECORD_KEYS if isinstance(node.get(k), list) and len(node[k]) >= 2]
        inner = [] if lists else [found for found in (walk(node[k], depth + 1) for k in S.WRAPPERS if k in node and depth < S.MOST_WRAPPERS) if found]
        return lists[0] if lists else inner[0] if inner else None

    payloads = [payload(0) for _ in range(400)]
    found = {}
    for r in S.json_records(sources(spark, *map(json.dumps, payloads))).orderBy("source_id", "row_number").collect():
        found.setdefault(r["source_id"], []).append((r["row_number"], json.loads(r["record"])))
    wanted = {i: [(k + 1, x) for k, x in enumerate(walk(p))] for i, p in enumerate(payloads) if walk(p)}
    assert found == wanted and len(wanted) > 100
    assert S.json_records(sources(spark, '[{"a": 1}, {"a": 2}', "", None, "[1]", "{")).count() == 0


PAGE = """<html><head><title>Acme - home</title><meta name="description" content="We make &amp; sell anvils"></head><body><nav>menu a@nav.org</nav>
<h1>Anvils for all</h1><script>var x = 1</script><p>Call +1 (555) 234-5678 or <b>mail</b> info@acme.org, logo@2x.png</p><a href="/about">About</a><a href="#x">no</a></body></html>"""


def test_page_facts(spark):
    pages = spark.createDataFrame([(1, "https://www.acme.org/en/", PAGE), (2, "https://b.org", None)], "page_id long, url string, html string")
    first, second = G.facts(pages).orderBy("page_id").collect()
    assert first["title"] == "Acme - home" and first["links"] == "https://www.acme.org/about" and first["emails"] == "a@nav.org info@acme.org"
    assert "var x" not in first["text_content"] and "menu" not in first["text_content"] and "mail info@acme.org" in first["text_content"]
    assert (second["title"], second["emails"], second["links"]) == ("", "", "")
    signals = G.research(pages).orderBy("page_id").first()
    assert (signals["summary"], signals["site_title"], signals["headings"]) == ("We make & sell anvils", "Acme - home", "Anvils for all")


def cards(n, kind="exhibitor-card-item"):
    return "".join(f'<div class="{kind}"><h3>Company {i}</h3><a href="/list/c{i}">more</a><p>Booth: 12B c{i}@x.org</p></div>' for i in range(n))


def test_page_kinds(spark):
    listing = f'<html><body><section id="past-exhibitors">{cards(11)}</section></body></html>'
    detail = '<html><body><a href="/x">Back to directory</a></body></html>'
    pages = spark.createDataFrame([(1, "https://fair.org/page#past-exhibitors", listing), (2, "https://fair.org/page", listing), (3, "https://fair.org/a/b", detail), (4, "https://acme.org/", PAGE)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in G.classify(pages).collect()}
    assert rows[1]["page_type"] == rows[2]["page_type"] == "DIRECTORY" and min(rows[1]["confidence"], rows[2]["confidence"]) >= 0.75
    assert (rows[3]["page_type"], rows[3]["confidence"]) == ("DETAIL", 0.85) and rows[4]["page_type"] == "SINGLE_COMPANY"
    found = G.entries(pages.where("page_id = 1")).collect()
    assert len(found) == 11 and {r["name"] for r in found} == {f"Company {i}" for i in range(11)}
    assert found[0]["link"] == "https://fair.org/list/c0" and found[0]["booth"] == "12B" and found[0]["email"] == "c0@x.org"


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("", "EMPTY"), (None, "EMPTY"), ("no_useful_personalization", "NO_USEFUL_DATA"), ("Hi {{firstName}}", "PLACEHOLDER"), ("I was Impressed By the work of all your people there", "CLICHE"),
        ("Since you travel frequently to many places this may help you a lot", "ASSUMPTION"), ("One two. Three four. Five six. Seven eight.", "TOO_MANY_SENTENCES"), ("Too short a text.", "TOO_SHORT"), ("word " * 66, "TOO_LONG"),
        ("Your new plant in Oslo ships twice as many anvils as the old one did.", None),
    ],
)
def test_quality_gate(spark, text, reason):
    assert one(spark, T.quality(F.lit(text).cast("string"))) == reason


@pytest.mark.parametrize(
    ("template", "wanted"),
    [
        ("Hi {{ firstName }}!", "Hi Ann!"), ("{{#if firstName}}Hi {{firstName}}{{else}}Hello{{/if}}", "Hi Ann"), ("{{#if city}}in {{city}}{{else}}abroad{{/if}}", "abroad"), ("{{#if firstName}}a{{#if city}}b{{/if}}c{{/if}}", "ac"),
        ("{{#if blank}}x{{/if}}.", "."), ("{{<b>firstName</b>}}", "Ann"), ("{{#if&nbsp;firstName}}y{{/if}}", "y"), ("{{nobody}} {{/if}}", " "), ("$1 \\ {{price}}", "$1 \\ $5"), (None, ""),
    ],
)
def test_render(spark, template, wanted):
    context = {"firstName": F.lit("Ann"), "city": F.lit(None).cast("string"), "blank": F.lit("  "), "price": F.lit("$5")}
    assert one(spark, T.render(F.lit(template).cast("string"), context)) == wanted


@pytest.mark.parametrize(("line", "phone"), [("Phone: +91 98765 43210", "+91 98765 43210"), ("+1 (555) 123-4567", "+1 (555) 123-4567"), ("9876543210", "9876543210"), ("Ann, Mob: 98765 43210", "98765 43210"), ("reach me at +1 (555) 234-5678 now", "+1 (555) 234-5678"), ("room 12", None), (None, None)])
def test_phone_of_line(spark, line, phone):
    assert one(spark, T.phone_of_line(F.lit(line).cast("string"))) == phone


def test_names_and_lines(spark):
    assert one(spark, T.name_from_profile(F.lit("https://www.linkedin.com/in/ann-van-dyk-1a2b3c4d"))) == "Ann Van Dyk"
    assert one(spark, E.line(("A", "B", "C"), {"A": F.lit('x "y", z'), "C": F.lit(None)})) == '"x ""y"", z",,'
    assert one(spark, E.line(("A", "B"), {"A": F.lit("x")}, quote_all=True)) == '"x",""'
    with pytest.raises(ValueError):
        E.line(("A",), {"Z": F.lit(1)})


def test_written_export(spark, tmp_path):
    rows = spark.range(3).select(E.line(("Id", "B"), {"Id": F.col("id")}).alias("line"))
    E.write(rows, ("Id", "B"), f"file://{tmp_path}/out")
    text = "".join(p.read_bytes().decode() for d in sorted((tmp_path / "out").iterdir()) for p in sorted(d.glob("part-*")))
    assert text == "﻿Id,B\r\n0,\r\n1,\r\n2,\r\n"


@pytest.mark.parametrize("name", catalog.TESTED_BY_VECTORS)
def test_queries_run_over_whole_tables(spark, name):
    found = catalog.queries()[name](spark, SF)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    if name in ("u01_page_class", "u05_page_facts", "u06_research", "u09_site_lead"):
        assert len(rows) == pages
    if name in ("s11_engagement_csv", "s12_company_csv"):
        assert rows and all(r["line"].count(",") >= 10 for r in rows)


@pytest.mark.parametrize("depth", [1, 4, 5, 6, 12])
def test_conditions_nested_to_any_depth(spark, depth):
    """The innermost condition fails: only its else branch and what stands around it is shown."""
    opened = "".join(f"{{{{#if a{i}}}}}{i}" for i in range(depth))
    template = opened + "{{#if city}}x{{else}}c{{/if}}" + "".join("{{else}}no{{/if}}" for _ in range(depth))
    context = {f"a{i}": F.lit("v") for i in range(depth)} | {"city": F.lit(" ")}
    assert one(spark, T.render(F.lit(template), context)) == "".join(map(str, range(depth))) + "c"
    hidden = context | {"a0": F.lit(None).cast("string")}
    assert one(spark, T.render(F.lit(template + "{{city}}|{{/if}}{{#if city}}y"), hidden)) == "no |"
