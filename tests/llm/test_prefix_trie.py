"""The prefix trie against a trie in memory: copies, long common prefixes, sequences that end on the way, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("marlspike.llm")
from marlspike.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    original = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            original[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    original = {c: [x[3:] for x in sorted(turns)] for c, turns in original.items()}
    members = defaultdict(list)
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = original.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:] if rebuild else turns
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        totals[p] = (sum(totals[q][0] for q in children[p]) or 1, own + sum(totals[q][1] for q in children[p]))
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, last in m if last))).encode()).hexdigest()
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(m), len(children[p]), *totals[p], ends(m)) for p, m in members.items()), key=repr)


def found(frame, rebuild=True):
    sequences, _ = prefix_trie.sequences(frame)
    return sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(sequences) if rebuild else sequences).select(*COLUMNS).collect()), key=repr)


def conversations(n, seed):
    """Branching turns, a start that many share, copies of one conversation, and prefixes of a long one."""
    rng = random.Random(seed)
    start = [("user", "hello " * k) for k in range(12)]
    rows = []
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:
            turns = start
        elif kind < 0.5:
            turns = start[: rng.randint(0, 12)] or start[:1]
        elif kind < 0.8:
            turns = start[: rng.choice([4, 9])] + [(rng.choice("ab"), rng.choice("xyz") * rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
        else:
            turns = [(rng.choice(["user", "bot"]), rng.choice(["", "é", "zz"])) for _ in range(rng.randint(1, 5))]
        rows += [(c * 7 - 50, k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [512, 8, 1])
def test_equals_a_trie_in_memory(spark, monkeypatch, local):
    """Every size of local buckets gives the same nodes: without rounds, with some, and with as many as there are forks."""
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = conversations(90 if local > 1 else 25, 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(frame, rebuild=False) == brute(rows, rebuild=False)
    if local != 1:
        assert found(frame) == brute(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a very long text, a turnless rebuilt conversation, clashing columns, no rows."""
    rows = [(None, 1, "user", "no id"), (200, None, "user", "first"), (200, 0, None, None), (200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "user", "a"), (201, 0, "user", "w " * 300_000), (-150, 0, "user", "x"), (-100, 0, "user", "y")]
    lonely = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 1)  # conversation 300 is absent
    rows.append((lonely, 0, "user", "goes"))
    frame = spark.createDataFrame([(*r, 1, [2]) for r in rows], SCHEMA + ", depth int, path array<int>")
    assert found(frame) == brute(rows) and found(frame, rebuild=False) == brute(rows, rebuild=False)
    root = next(r for r in found(frame) if r[1] == 0)
    assert root[7] == hashlib.sha256(str(lonely).encode()).hexdigest()
    assert found(frame.limit(0)) == []
