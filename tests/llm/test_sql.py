"""The queries that have SQL against DuckDB on the same files."""

import gzip

import duckdb
import pytest

pytest.importorskip("marlspike.llm")
from marlspike.llm import host_rules, oracles, queries, warc  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    wanted = con.execute(oracles.SQL[name])
    names = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(n) for n in names]
    found = queries.queries()[name](spark, SF).select(*names)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in wanted.fetchall())


def test_warc_equals_sql_with_repeated_pages(spark, tmp_path):
    """Every row of pages is a record, with its own url and record id, however often its id and payload stand."""
    rows = [(1, "http://a", "same"), (1, "http://b", "same"), (1, "http://b", "same"), (2, "http://c", "same"), (2, "http://d", "same"), (3, "http://e", "own"), (3, "http://f", "own"), (None, "http://g", "none"), (None, "http://h", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({oracles.SQL['op4_warc']}) WHERE page_id IS NOT NULL").fetchall()
    found = [tuple(r) for r in queries.op4_warc(spark, str(tmp_path)).collect()]
    assert len(found) == len(rows) and sum(r[0] is None for r in found) == 2
    assert sorted(map(str, (r for r in found if r[0] is not None))) == sorted(map(str, wanted))
    manifest, folder = warc.archive(pages)
    assert sorted(r["url"] for r in warc.read_archives(spark, manifest, folder).where("last").collect()) == sorted(u for _, u, _ in rows)
    ids = [line for r in manifest.collect() for line in gzip.open(r["path"]).read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(ids) == len(rows)


def test_hosts_that_fail_often_lose_their_good_documents(spark, tmp_path):
    """kept differs from the base verdict: bad hosts are rejected, small ones and those near the corpus's rate are not."""
    good = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}x{k}" for k in range(30))
    rows = []
    for host, failed, n in [*((f"h{i}", 2 + i % 3, 150) for i in range(20)), ("bad", 60, 100), ("worse", 150, 160), ("small", 2, 2), (None, 45, 50), ("middling", 8, 60)]:
        rows += [(len(rows) + i, "too short" if i < failed else good(len(rows) + i), host) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op6_host_rules(spark, str(tmp_path)).collect()}
    lost = {host for i, _, host in rows if found[i]["kept"] != (not found[i]["base_failed"])}
    assert lost == {"bad", "worse", None} and all(found[i]["kept"] is False for i, _, host in rows if host in lost)
    # the verdicts by loop
    count = {}
    for i, _, host in rows:
        n, k = count.get(host, (0, 0))
        count[host] = (n + 1, k + found[i]["base_failed"])
    total, failures = (sum(c[j] for c in count.values()) for j in (0, 1))
    mean = failures / total
    between, noise = sum(k * k / n for n, k in count.values()) / total - mean**2, mean * (1 - mean) * len(count) / total
    s = min(max((mean * (1 - mean) - between) / (between - noise), 1.0), 1e6)
    rate = {h: (k + mean * s) / (n + s) for h, (n, k) in count.items()}
    assert lost == {h for h, (n, _) in count.items() if rate[h] - 2.326 * (rate[h] * (1 - rate[h]) / (n + s + 1)) ** 0.5 > min(3 * mean, (1 + mean) / 2)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(f"SELECT doc_id, base_failed, kept FROM ({oracles.SQL['op6_host_rules']})").fetchall()
    assert {r[0]: r[1:] for r in wanted} == {i: (r["base_failed"], r["kept"]) for i, r in found.items()}


def test_hosts_are_judged_by_rule(spark, tmp_path):
    """A rule that seldom fails speaks against a host that the base rules together would spare; one rule of style alone doesn't, two do."""
    good = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}x{k}" for k in range(30))
    repeated = lambda i: f"{good(i)} " + "one two three four five six seven eight " * 3
    signs = lambda i: good(i) + " # $ % & |"
    lines = lambda i: good(i) + "\nsame line" * 6 + " # $ % & | < >"
    rows = []
    for host, bad, failed, n in [*((f"h{i}", lambda _: "short", 20 + i % 5, 150) for i in range(20)), ("repeats", repeated, 20, 150), ("signs", signs, 150, 150), ("styled", lines, 140, 150)]:
        rows += [(len(rows) + i, bad(i) if i < failed else good(len(rows) + i), host) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    measured = host_rules.measure(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    verdicts = {r["host"]: r for r in host_rules.hosts(measured).collect()}
    assert {h: r["host_rules"] for h, r in verdicts.items() if r["host_rules"]} == {"repeats": ["repeats"], "signs": ["symbols"], "styled": ["symbols", "dup_lines"]}
    assert {h for h, r in verdicts.items() if r["host_rejected"]} == {"repeats", "styled"}
    found = {r["doc_id"]: r for r in queries.op6_host_rules(spark, str(tmp_path)).collect()}
    assert all(r["kept"] == (not r["base_failed"] and rows[i][2] not in ("repeats", "styled")) for i, r in found.items())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({oracles.SQL['op6_host_rules']})").fetchall()} == {i: r["kept"] for i, r in found.items()}
