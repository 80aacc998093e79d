"""Tables that change against dictionaries; layers; components, greedy de-duplication and reservation against loops."""

import random

import pytest
from pyspark.sql import functions as F

from marlspike import plans
from marlspike.operators import inbox, layers, leads
from marlspike.plans import tables
from marlspike.plans.components import components

SCHEMA = "a long, b string, value long, note string"


def content(t):
    return {(r["a"], r["b"]): (r["value"], r["note"]) for r in t.read().collect()}


def test_writes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    t = tables.Table(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["a", "b"], buckets=5)
    have: dict = {}
    assert t.version() == -1 and t.read().count() == 0
    for step in range(9):
        rows = [(rng.choice([None, *range(12)]), rng.choice("xy"), rng.randrange(6), rng.choice([None, "n"])) for _ in range(rng.choice([0, 3, 8]))]
        new = spark.createDataFrame(rows, SCHEMA)
        usable = [r for r in rows if r[0] is not None]
        kind = step % 3
        if kind == 0:
            t.insert_ignore(new)
            for r in sorted(usable, key=lambda r: (r[2], r[3] is not None, r[3] or "")):
                have.setdefault(r[:2], r[2:])
        elif kind == 1:
            t.upsert(new, order="value")
            best: dict = {}
            for r in sorted(usable, key=lambda r: (-r[2], r[3] is not None)):
                best.setdefault(r[:2], r[2:])
            for k, v in best.items():
                if k not in have or v[0] >= have[k][0]:
                    have[k] = v
        else:
            t.delete(new.select("a", "b"))
            for r in usable:
                have.pop(r[:2], None)
        assert content(t) == have and t.read().count() == len(have)
    versions = t.version()
    t.vacuum(keep=2)
    assert content(t) == have and t.read(versions - 1).count() >= 0 and len(plans.names(spark, f"{t.folder}/manifest")) == 2
    t.delete(spark.createDataFrame([("x",), ("y",)], "b string"), "b")
    assert content(t) == {} and t.manifest() == {}


def test_only_touched_buckets_are_written_and_a_failed_run_leaves_the_manifest(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k long, v long").schema
    t = tables.Table(spark, f"file://{tmp_path}/t", schema, ["k"])
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert t.upsert(rows) == 0 and t.upsert(rows) == 0  # nothing new: no version
    before = t.manifest()
    assert t.upsert(spark.createDataFrame([(7, 0), (8, 16)], "k long, v long")) == 1
    assert len(t.changed_since(0)) == 1 and len(before) == 64
    held = t.manifest()

    def fails(*_):
        raise OSError("stopped")

    monkeypatch.setattr(tables, "put", fails)
    with pytest.raises(OSError):
        t.upsert(rows)
    assert t.manifest() == held and t.read().where("k = 7").first()["v"] == 0
    monkeypatch.undo()
    # another writer was quicker
    behind = tables.Table(spark, t.folder, schema, ["k"])
    monkeypatch.setattr(behind, "version", lambda: 0)
    with pytest.raises(FileExistsError):
        behind.upsert(spark.createDataFrame([(9, 0)], "k long, v long"))
    assert t.version() == 1 and t.read().count() == 500


def test_layers_take_only_what_changed(spark, tmp_path):
    raw = spark.createDataFrame([(k, 0, None if k == 5 else f"Firm {k % 40} Ltd", None, f"a{k % 50}@x.example", None, "Rome") for k in range(90)], layers.BRONZE.rsplit(",", 1)[0])
    folder, is_probe = f"file://{tmp_path}/l", F.col("row_number") % 3 == 0
    t = layers.ingest(raw, folder, is_probe)
    first = {n: x.version() for n, x in t.items()}
    assert {r["layer"]: r["n_rows"] for r in layers.counters(t).collect()} == {"bronze": 90, "silver": 89, "gold": 30}
    layers.ingest(raw, folder, is_probe)
    assert {n: x.version() for n, x in t.items()} == first
    changed = spark.createDataFrame([(5, 0, "Mended Inc", None, "new@x.example", None, "Rome"), (60, 0, None, None, None, None, None)], raw.schema)
    layers.ingest(changed, folder, is_probe)
    assert {r["layer"]: (r["n_rows"], r["refused"]) for r in layers.counters(t).collect()}["bronze"] == (90, 1)
    assert t["silver"].read().count() == 89 and t["gold"].read().where("row_number = 60").count() == 0
    assert len(t["bronze"].changed_since(first["bronze"])) == 2 and len(t["silver"].changed_since(first["silver"])) == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(1000, 1400)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5000, k) for k in range(5001, 5200)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, root(x)) for x in list(parent))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def greedy(pairs):
    keys, owner, out = {}, {}, {}
    for r, k in pairs:
        if r is not None and k is not None:
            keys.setdefault(r, set()).add(k)
    for r in sorted(keys):
        known = [owner[k] for k in keys[r] if k in owner]
        if known:
            out[r] = min(known)
        else:
            owner.update(dict.fromkeys(keys[r], r))
    return out


def test_greedy_duplicates(spark, monkeypatch):
    """A chain of a thousand rows, a key that a third of the rows have, random keys; folded and in rounds."""
    rng = random.Random(6)
    chain = [(r, f"c{r + j}") for r in range(1000) for j in (0, 1)]
    some = [(2000 + r, f"k{rng.randrange(150)}") for r in range(200) for _ in range(rng.randint(0, 3))] + [(2000 + r, "hot") for r in range(0, 200, 3)] + [(None, "k1"), (2001, None)]
    pairs = spark.createDataFrame(chain + some, "row_number long, key string")
    assert dict(map(tuple, leads.greedy_duplicates(pairs).collect())) == greedy(chain + some)
    monkeypatch.setattr(leads, "FOLD_PAIRS", 40)
    assert dict(map(tuple, leads.greedy_duplicates(spark.createDataFrame(some, "row_number long, key string")).collect())) == greedy(some)
    assert leads.greedy_duplicates(pairs.where("false")).count() == 0


def test_reservation_of_a_large_tenant(spark):
    """100,000 slots of one tenant beside small ones, against the loop."""
    rng = random.Random(8)
    slots = [(0, n, n // 100, rng.randrange(60_000), rng.randint(0, 4)) for n in range(100_000)] + [(t, n, 2000 + t, n, 2) for t in range(1, 4) for n in range(5)]
    slots = list({(s[2], s[3]): s for s in slots}.values())
    budgets = {c: rng.randint(0, 90) for c in {s[2] for s in slots}}
    rng.shuffle(slots)
    # one or two candidates of each slot
    number = {(s[2], s[3]): 1 + (s[2] + s[3]) % 2 for s in slots}
    left, serving, wanted = dict(budgets), set(), {}
    for t, _, c, m, batch in sorted(slots):
        size = min(batch, number[c, m], left[c])
        if size > 0 and (t, m) not in serving:
            left[c] -= size
            serving.add((t, m))
            wanted[c, m] = size
    frame = spark.createDataFrame(slots, "tenant long, n long, campaign_id long, mailbox long, batch long")
    candidates = frame.select("campaign_id", "mailbox", F.explode(F.sequence(F.lit(1).cast("long"), 1 + (F.col("campaign_id") + F.col("mailbox")) % 2)).alias("id")).withColumns({"follow_up": F.lit(False), "due": F.lit(0)})
    found = inbox.reserve(candidates, frame, spark.createDataFrame(list(budgets.items()), "campaign_id long, budget long"))
    sizes = {(r[0], r[1]): r[2] for r in found.groupBy("campaign_id", "mailbox").count().collect()}
    assert sizes == wanted and len(wanted) > 10_000
