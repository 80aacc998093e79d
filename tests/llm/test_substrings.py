"""Substring de-duplication against brute force over all windows: hot lines, large buckets, odd rows."""

import random
import re

import pytest

pytest.importorskip("marlspike.llm")
from pyspark.sql import functions as F  # noqa: E402

from marlspike.llm import substrings  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows, window):
    """Kept words of each row, by a dictionary of all windows."""
    texts = [WORD.findall(t or "") for _, t in rows]
    owner = {}
    for (i, _), words in zip(rows, texts):
        for k in range(len(words) - window + 1) if i is not None else ():
            w = tuple(words[k : k + window])
            owner[w] = min(owner.get(w, i), i)
    out = []
    for (i, _), words in zip(rows, texts):
        gone = {k + j for k in range(len(words) - window + 1) if i is not None and owner[tuple(words[k : k + window])] < i for j in range(window)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def found(docs, window):
    return sorted((tuple(r) for r in substrings.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)


def corpus(n, seed, words=400):
    """Texts with a common line, passages that some share, copies, repeated words and limits of several kinds."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["naïve", "日本語", "A", "a", " x"]
    some = lambda k: rng.choices(vocabulary, k=k)
    line, passages = some(9), [some(rng.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [some(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            parts += [line if rng.random() < 0.5 else rng.choice(passages), some(rng.randint(0, 12))]
        if rng.random() < 0.2:
            parts.append([rng.choice(vocabulary)] * rng.randint(1, 40))
        rows.append((rng.randrange(3 * n), "".join(w + rng.choice([" ", "\n", " \t", "\x0b"]) for p in parts for w in p)))
    return rows + [(rng.randrange(3 * n), rows[rng.randrange(n)][1]) for _ in range(n // 3)]


@pytest.mark.parametrize("window", [1, 2, 8])
def test_equals_brute_force(spark, window):
    rows = corpus(120, window)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs, window) == brute(rows, window)


def test_hot_runs_of_words_and_large_buckets(spark, monkeypatch):
    """The ways of hot groups give the same: nearly all runs listed as hot, and every bucket too large to be sorted."""
    rows = corpus(150, 3, words=12)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    wanted = brute(rows, 8)
    assert sum(r[2] > 0 for r in wanted) > 50
    monkeypatch.setattr(substrings, "HOT", 3)
    assert len(substrings.hot_minimisers(docs.select(F.col("doc_id").alias("doc"), "text"), 8)) > 20
    assert found(docs, 8) == wanted
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 900)
    assert found(docs, 8) == wanted
    monkeypatch.setattr(substrings, "HOT", 1 << 30)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 0)
    assert found(docs, 8) == wanted


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated ids and rows, clashing columns, no rows."""
    rng = random.Random(11)
    long = " ".join(f"word{rng.randrange(9000)}" for _ in range(180_000))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(5, long), (6, "before " + long[: len(long) // 2]), (2, None), (3, ""), (4, " \n\t "), (7, shared), (7, shared), (7, "own " + shared), (8, shared + " tail"), (None, shared), (None, None), (1, "short text")]
    docs = spark.createDataFrame([(*r, "own", 3) for r in rows], SCHEMA + ", kept_text string, bucket int")
    out = substrings.remove_repeats(docs)
    assert out.columns == ["doc_id", "bucket", "n_words", "n_removed", "kept_text"] and {r["bucket"] for r in out.select("bucket").collect()} == {3}
    assert found(docs, 50) == brute(rows, 50)
    assert found(docs.limit(0), 50) == []


def test_piece_limits_of_long_texts(spark):
    """Windows across the limits of pieces are seen, wherever the copy's limits fall."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(150_000))
    seen = {}
    for piece, base in substrings.pieces(pa.array(["a b c", text]), 50, np.zeros(0, np.uint64)):
        for row, start, n in zip(piece.row, piece.start, piece.windows):
            if row + base == 1:
                seen.update({start + k: seen.get(start + k, 0) + 1 for k in range(n)})
    assert seen == {k: 1 for k in range(150_000 - 49)}
