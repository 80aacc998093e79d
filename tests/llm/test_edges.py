"""Defined results of the operators for nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib

import pytest

pytest.importorskip("marlspike.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marlspike.llm import bpe, host_rules, licenses, mixing, near_copies, ngram_lm, simhash, syncmers, token_edits, toxicity, warc  # noqa: E402
from marlspike.llm.queries import RANK_FILE  # noqa: E402

RANKS, PATTERN = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
LONG = "alpha beta gamma delta " * 60_000
ROWS = [(1, "A plain text of words", "a"), (2, None, "a"), (3, "", None), (4, LONG, "b"), (1, "A plain text of words", "a"), (None, "a row without an id", "b"), (5, " \n\t ", "b"), (6, "naïve – 日本語 text", "b")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("score", F.lit("own")), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels) == toxicity.NO_MODEL


def test_syncmers(docs, empty):
    rows = syncmers.successor_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("fingerprint", F.lit("own"))).collect()
    found = {r["doc_id"]: r for r in rows}
    assert found[2]["n_chars"] == 0 and found[2]["fingerprint"] == "" and found[2]["near_edited"] == 1.0 and found[2]["near_next"] == 1.0
    assert found[4]["n_chars"] == len(LONG) and found[6]["near_next"] == 0.0
    assert len(syncmers.successor_edits(docs).collect()) == len(ROWS)
    assert syncmers.successor_edits(empty).count() == 0
    same = {r["fingerprint"] for r in syncmers.fingerprint(docs.where("doc_id = 1")).collect()}
    assert len(same) == 1


def test_syncmers_of_inserted_paragraphs(docs):
    """Common text counts on every diagonal and over the whole length, and any change of a long text changes its fingerprint."""
    import random

    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    parts = [words(400) for _ in range(4)]
    own = " ".join(parts)
    near = " ".join(x for part in parts for x in (part, words(40)))
    short = " ".join([*parts[:2], *parts[3:]])
    changed = own[: len(own) // 2] + "#" + own[len(own) // 2 + 1 :]
    a, b, c, d, e = syncmers.sketches([own, near, short, changed, words(1600)])
    assert syncmers.likeness(a, b) == syncmers.likeness(b, a) == pytest.approx(2 * len(own) / (len(own) + len(near)), abs=0.02)
    assert syncmers.likeness(a, c) == pytest.approx(2 * len(short) / (len(own) + len(short)), abs=0.02)
    assert 0.98 < syncmers.likeness(a, d) < 1 and syncmers.to_text(a) != syncmers.to_text(d)
    assert syncmers.likeness(a, e) < 0.02 and syncmers.likeness(a, a) == 1.0
    again = syncmers.from_text(syncmers.to_text(b))
    assert (again[0] == b[0]).all() and (again[1] == b[1]).all()


def test_bpe(docs, empty):
    rows = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("own")), RANKS, PATTERN, piece=1000), RANKS, PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows) and len(rows) == len(ROWS)
    whole = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS, PATTERN).collect()}
    assert all(r["ids"] == whole[r["doc_id"]] for r in rows) and whole[2] == []
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_warc(spark):
    big = "x" * (3 * warc.CHUNK + 7)
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", None), (4, "http://d", big), (4, "http://d", big), (None, "http://n", "same"), (5, "http://e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest, folder = warc.archive(pages.withColumns({"digest": F.lit("own"), "chunk": F.lit("own"), "key": F.lit("own"), "row": F.lit(1)}))
    chunks = warc.read_archives(spark, manifest, folder).collect()
    last = [r for r in chunks if r["last"]]
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in last), key=str) == sorted([
        ("1", "revisit", "2", 4, sha("same")), ("2", "response", None, 4, sha("same")), (None, "revisit", "2", 4, sha("same")), ("3", "revisit", "5", 0, sha("")), ("5", "response", None, 0, sha("")), ("4", "response", None, len(big), sha(big)), ("4", "response", None, len(big), sha(big)),
    ], key=str)
    parts = sorted((r["chunk"], bytes(r["data"])) for r in chunks if r["key"] == "4")
    assert len(parts) == 8 and b"".join(d for _, d in parts[::2]).decode() == big and max(len(d) for _, d in parts) <= warc.CHUNK
    none, where = warc.archive(pages.where("false"))
    assert none.count() == 0 and warc.read_archives(spark, none, where).count() == 0


def test_warc_keeps_any_key(spark):
    """String keys come back as they were, with colons, blanks or line ends, and "null" is not null."""
    keys = ["a:b", "null", "", None, "ü €\r\n<x>", "k", "n"]
    pages = spark.createDataFrame([(k, "u", "same") for k in keys] + [(k, "u", f"own {k}") for k in keys], "page_id string, url string, html string")
    manifest, folder = warc.archive(pages)
    found = [(r["key"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, manifest, folder).collect()]
    largest = max(k for k in keys if k is not None)
    wanted = [(k, "response", None) for k in keys] + [(k, *(("response", None) if k == largest else ("revisit", largest))) for k in keys]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_mixing(docs, empty):
    rows = mixing.assign(docs.withColumn("target", F.lit("own"))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["taken"] for r in rows if r["doc_id"] == 1} == {next(r["taken"] for r in rows if r["doc_id"] == 1)}
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.assign(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_split_tree(spark):
    quotas = spark.createDataFrame([(1, 13), (2, 0), (3, 40), (4, 7)], "rank int, n long")
    rows = mixing.split_tree(quotas, 8).collect()
    for rank, n in ((1, 13), (2, 0), (3, 40), (4, 7)):
        assert sum(r["n"] for r in rows if r["rank"] == rank) == n and all(r["n"] >= 0 for r in rows)
    sizes = [sum(r["n"] for r in rows if r["shard"] == s) for s in range(8)]
    assert sum(sizes) == 60 and max(sizes) - min(sizes) <= 1


def test_split_tree_of_many_sources(spark):
    """Quotas add up for each source and are as even as they can be for each shard; the draws are of the hypergeometric kind."""
    quotas = spark.range(1, 100_001).select(F.col("id").alias("rank"), (F.col("id") % 5).alias("n"))
    rows = mixing.split_tree(quotas, 8)
    total = 200_000
    by_rank = rows.groupBy("rank").agg(F.sum("n").alias("n"))
    assert by_rank.where("n <> rank % 5").count() == 0 and by_rank.count() == 80_000
    sizes = [r["n"] for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == total and len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    # of four blocks of a source, none falls to shard 0 with a chance of (7 / 8) ** 4
    hit = rows.where("shard = 0 and rank % 5 = 4").count()
    assert abs(hit / 20_000 - (1 - (7 / 8) ** 4)) < 0.015


def test_ranks_of_many_sources(spark):
    names = [f"s{(i * 7919) % 5003}" for i in range(5003)] + [None, "\U0001f600", "\uffff"]
    rows = mixing.ranks(spark.createDataFrame([(x,) for x in names], "source string").repartition(7)).collect()
    assert [r["source"] for r in sorted(rows, key=lambda r: r["rank"])] == [*sorted(x for x in names if x is not None), None]
    assert sorted(r["rank"] for r in rows) == list(range(1, len(names) + 1))


def test_host_rules(docs, empty):
    measured = host_rules.measure(docs.withColumn("n_words", F.lit("own")))
    verdicts = host_rules.hosts(measured)
    rows = host_rules.judge(measured, verdicts).collect()
    assert len(rows) == len(ROWS) and all(r["n_words"] == len((r["text"] or "").split()) for r in rows if r["doc_id"] != 6)
    assert {r["host"]: (r["host_documents"], r["host_failures"]) for r in verdicts.collect()} == {"a": (3, 3), None: (1, 1), "b": (4, 4)}
    long = next(r for r in rows if r["doc_id"] == 4)
    assert long["n_repeat_words"] == long["n_words"] == 240_000 and long["base_failed"]
    nothing = host_rules.measure(empty)
    assert host_rules.judge(nothing, host_rules.hosts(nothing)).count() == 0


def test_simhash(docs, empty):
    found = simhash.components(simhash.fingerprints(docs.withColumn("simhash", F.lit("own")))).collect()
    assert len(found) == len(ROWS)
    blank = [r for r in found if r["simhash"] == 0]
    assert {r["doc_id"] for r in blank} == {2, 3, 5} and {r["component_id"] for r in blank} == {2}
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    assert simhash.components(simhash.fingerprints(empty)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash.deduplicate(docs).collect()) == [0, 1, 2, 4, 6]


def test_simhash_buckets_beyond_the_limit(spark):
    """Crowded buckets are dealt out again; components stay those of all pairs."""
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base))
    name = {p: p for p in prints}

    def root(p):
        while name[p] != p:
            p = name[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(nodes, bucket=4).collect()]
    assert all(root(u) == root(v) for u, v in links)
    again = {p: p for p in prints}

    def find(p):
        while again[p] != p:
            p = again[p]
        return p

    for u, v in links:
        x, y = sorted((find(u), find(v)))
        again[y] = x
    assert {p: find(p) for p in prints} == {p: root(p) for p in prints}


def test_licenses(spark, empty):
    mit = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "Under the MIT License. under the mit license", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000 + mit, "x"), (5, "permission granted for charge", "x"), (None, "CC BY-NC", "x"), (6, "under the mit license version 2", "x")]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("own"))).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["labels"]) == (2, 0, 4, "mit")
    assert (found[2]["n_words"], found[2]["labels"], found[2]["score"], found[2]["first_word"]) == (0, "", 0.0, None)
    assert found[4]["labels"] == "mit" and found[4]["base_labels"] == "" and 0.4 <= found[4]["score"] <= 1
    assert found[5]["labels"] == "" and found[None]["base_labels"] == "cc-by-nc"
    assert licenses.scan(empty).count() == 0


def test_licenses_of_texts_with_many_licence_words(spark):
    """Verbatim notices keep their labels and full score, however many other licence words the text holds."""
    vocabulary = " ".join(w for w in licenses.VOCABULARY for _ in range(2))
    every = [(i, f"{vocabulary} ; {' '.join(words)} ; {vocabulary}", "x") for i, (_, words, _) in enumerate(licenses.INDEX)]
    whole = " ; ".join(" ".join(words) for _, words, _ in licenses.INDEX)
    rows = [*every, (100, whole, "x"), (101, licenses.TEMPLATES[0][1], "x"), (102, vocabulary, "x"), (103, "no licence here", "x")]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, _, _) in enumerate(licenses.INDEX):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == pytest.approx(1.0)
    assert found[100]["labels"] == ",".join(sorted({label for label, _, _ in licenses.INDEX}))
    assert found[101]["labels"] == "mit" and found[101]["score"] == pytest.approx(1.0)
    assert (found[102]["labels"], found[102]["score"]) == (found[103]["labels"], found[103]["score"]) == ("", 0.0)


def test_licenses_by_paragraph_and_name(spark):
    """A single paragraph tells the licence, as do its name and version; words changed within it lower the score alone."""
    warranty = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM"
    texts = {
        "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2",
        warranty: "mit",
        "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation": "bsd",
        "available under the Eclipse Public License v2.0": "epl-2",
        "Boost Software License - Version 1.0 - August 17th, 2003": "bsl-1",
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify": "ofl-1.1",
        warranty.replace("MERCHANTABILITY", "USEFULNESS"): "mit",
        warranty.replace("COPYRIGHT HOLDERS", "OWNERS"): "",
        "the software is provided with a license": "",
        "license MIT, identifier SPDX": "",
    }
    docs = spark.createDataFrame([(i, text, "x") for i, text in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [found[i]["labels"] for i in range(len(texts))] == list(texts.values())
    assert found[1]["score"] > found[8]["score"] >= licenses.LEAST_SCORE and found[9]["score"] == 0.0


def test_token_edits(docs, empty):
    edit = lambda start, removed, inserted: F.struct(F.lit(start).alias("start"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(3, 2, "XY zed"), F.lit(None).cast("struct<start:int,removed:int,inserted:string>"), edit(10_000_000, 1, "end"))
    trees = token_edits.build_trees(docs.withColumn("edits", edits), RANKS, PATTERN)
    rows = token_edits.apply_edits(trees, RANKS, PATTERN).collect()
    encoding = bpe._encoding(open(RANKS, "rb").read(), PATTERN)
    for r in rows:
        text = r["text"] or ""
        wanted = text[:3] + "XY zed" + text[5:] + "end"
        assert r["edited_text"] == wanted and r["edited_tokens"] == len(encoding.encode_ordinary(wanted)) == sum(r["edited_tree"]["tokens"])
        assert r["n_tokens"] == len(encoding.encode_ordinary(text))
        assert r["encoded_chars"] < 10_000
    same = token_edits.apply_edits(trees.withColumn("edits", F.lit(None).cast("array<struct<start:int,removed:int,inserted:string>>")), RANKS, PATTERN)
    assert all(r["edited_text"] == (r["text"] or "") and r["edited_tokens"] == r["n_tokens"] for r in same.collect())
    assert token_edits.build_trees(empty, RANKS, PATTERN).count() == 0


def test_ngram_lm(docs, empty):
    model = ngram_lm.fit(docs)
    rows = ngram_lm.score(docs.withColumn("score", F.lit("own")), model).collect()
    assert len(rows) == len(ROWS) and all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 5)} == {1}
    assert {r["train_tokens"] for r in rows} == {sum(r["n_tokens"] for r in rows)}
    untrained = ngram_lm.score(docs, ngram_lm.fit(empty)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in untrained)
    assert ngram_lm.score(empty, model).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        now = spark.createDataFrame(after.collect(), after.schema)
        sizes.append(now.count())
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4] > 0


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns named like those that operators add."""
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"token{i % 977}x{i}" for i in range(60_000))
    rows = [(1, good, "a"), (1, good, "a"), (2, None, "a"), (3, "", None), (4, long, "b"), (None, good + " more", "b"), (5, "too short", None), (6, good.upper(), "c"), (7, " ".join(f"other{i}" for i in range(30)), None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit("own-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("score", "predicted", "n_words", "kept", "host_rate", "same", "node", "size", "shards", "place", "target", "ids", "n_tokens", "_rest_of_row", "_same")})
    spark.createDataFrame([(1, 0), (5, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept[name] = out.collect()
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns and all(r[c] == f"own-{'none' if r['doc_id'] is None else r['doc_id']}" for r in kept[name] for c in docs.columns[3:])
    ids = lambda name: sorted(r["doc_id"] or 0 for r in kept[name])
    assert ids("quality rules") == [0, 1, 1, 4, 6, 7]
    assert ids("near-duplicates") == [0, 1, 2, 4, 5, 7]  # 6 is 1 in capitals, 3 as empty as 2
    assert set(ids("mixing")) <= {r[0] or 0 for r in rows} and max(map(ids("mixing").count, range(8))) <= 4 and len(kept["bpe"]) == len(rows)
    assert len(kept["toxicity"]) <= len(rows)


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 2])
def test_pipeline_near_duplicates_equal_brute_force(spark, monkeypatch, bucket):
    """The stage keeps the smallest id of each component of pairs whose five-word shingles are similar by 0.8 or more, also
    where buckets are dealt out in parts."""
    import random

    import corpus_pipeline

    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    line = rng.choices(vocabulary, k=14)
    texts = []
    for size in (8, 30, 60, 120, 300, 300):
        base = rng.choices(vocabulary, k=size)
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 12):
            words = list(base)
            for i in rng.sample(range(size), min(edits, size)):
                words[i] = rng.choice(vocabulary)
            texts.append(" ".join(words + (line if edits % 2 else [])))
    texts += ["", None, "one two", "ONE two", *(" ".join(line + rng.choices(vocabulary, k=k)) for k in range(1, 40))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i + 1, texts[j], "x") for i, j in enumerate(order)]
    sets = {}
    for i, text, _ in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((find(a), find(b)))
                name[y] = x
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame([*rows, (None, "one two", "x")], SCHEMA), "")
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, *sorted({find(i) for i in sets})]
    assert kept.sparkSession is spark and corpus_pipeline.dedup_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_syncmers_successors_with_null_ids_and_many_ranges(spark, monkeypatch):
    """Ids in many ranges and parts of them, repeated ids, several null ids: each row's successor is the next one, nulls last."""
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 2)
    rows = [(k * 3 % 5000, f"text {k * 7919 % 1201} of {k}") for k in range(2500)] + [(k, f"again {k}") for k in (0, 300, 300, 4998)] + [(None, f"none {k}") for k in (4, 2, 9)] + [(None, None), (None, "none 2")]
    found = syncmers.successor_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    edited = []
    for (i, own), (_, following) in zip(order, order[1:] + order[:1]):
        cut = len(own) // 4
        edited.append((i, hashlib.sha256((own[: len(own) - cut] + following[:cut]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in found), key=repr) == sorted(edited, key=repr)


def test_mixing_uses_as_many_partitions_as_asked_for(spark, monkeypatch):
    """Runs of shards follow the number of partitions; places ascend within each shard of a partition."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    monkeypatch.setattr(mixing, "RUN_ROWS", 20)
    parts = mixing.mix(docs).select("shard", "place", F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in parts}) > 300
    seen = {}
    for r in parts:
        assert seen.get((r["part"], r["shard"]), -(1 << 63)) <= r["place"]
        seen[r["part"], r["shard"]] = r["place"]


def test_near_copies_of_one_group_cost_few_pairs(spark, monkeypatch):
    """Copies that are similar to one text, and to each other not quite: pairs grow with the copies, not with their square."""
    import random

    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(300):
        copy, at = list(words), rng.randrange(5, 110)
        copy[at], copy[at + 2] = f"x{k}", f"y{k}"
        rows.append((k + 2, " ".join(copy), "a"))
    docs = spark.createDataFrame([*rows, (1, " ".join(words), "a")], SCHEMA)
    tables, write = {}, near_copies.table
    monkeypatch.setattr(near_copies, "table", lambda df, name: tables.setdefault(name, []).append((out := write(df, name)).count()) or out)
    assert {r["component_id"] for r in near_copies.components(docs.select("doc_id", "text")).collect()} == {1}
    assert sum(tables["near-more"]) <= 20 * len(rows)


def test_near_copies_in_small_rounds_equal_those_in_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = []
    for nearest, more in ((1, 2), (1 << 30, 2)):
        monkeypatch.setattr(near_copies, "NEAREST", nearest)
        monkeypatch.setattr(near_copies, "MORE", more)
        found.append(sorted(map(tuple, near_copies.components(docs).collect())))
    assert found[0] == found[1]


def test_bit_filter_keeps_all_that_are_wanted(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), (F.col("id") * 3).alias("same"))
    flags = {(r["id"], r["same"]): r["in"] for r in near_copies.maybe_in(rows, rows.where("same % 40 = 0"), ["id", "same"], "in").collect()}
    assert len(flags) == 20_000 and all(flags[k] for k in flags if k[1] % 40 == 0)
    assert sum(flags[k] for k in flags if k[1] % 40) < 1_000
