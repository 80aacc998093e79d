"""Hard negatives against brute force: ties, a vector that a third of the rows hold, small blocks and digits, odd rows."""

import math
import random

import pytest

pytest.importorskip("marlspike.llm")
from marlspike.llm import negatives  # noqa: E402

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=10):
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if i % every == 0}:
        scored = sorted((-score(v, w), j, other) for j, other, w in usable)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            p = -s
            fitting = [(-t, k) for t, k, other in scored if other != label and 80 * p <= -100 * t <= 100 * p]
            out += [(i, j, rank, k, p, t) for rank, (t, k) in enumerate(fitting[:5], 1)]
    return sorted(out)


def found(docs, every=10):
    mined = negatives.mine(docs, lambda vec_id: vec_id % every == 0)
    return sorted(tuple(r) for r in mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, seed, width=6, step=0.2):
    """Few different components, so that scores tie; a third of the rows hold one vector."""
    rng = random.Random(seed)
    one = [rng.randint(1, 4) * step for _ in range(width)]
    return [(i, rng.randrange(4), one if rng.random() < 0.33 else [rng.randint(-2, 4) * step for _ in range(width)]) for i in range(n)]


def test_ties_blocks_and_digits(spark, monkeypatch):
    rows = vectors(160, 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = brute(rows)
    assert len(wanted) > 300 and found(docs) == wanted
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 30)
    monkeypatch.setattr(negatives, "DIGITS", 2)
    monkeypatch.setattr(negatives, "PIECE_SCORES", 40)
    assert found(docs) == wanted


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.uniform(0, 3e6) for _ in range(5)]) for i in range(60)]
    assert max(r[4] for r in brute(rows)) > 1 << 53 and found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ValueError, match="don't fit"):
        found(spark.createDataFrame([(0, 1, [1e9])], SCHEMA))


def test_odd_rows(spark):
    """Nulls, non-finite components, vectors of several lengths, repeated ids and rows, clashing columns, no rows."""
    rows = vectors(40, 2) + [(10, 1, None), (None, 1, [0.5] * 6), (20, None, [0.5] * 6), (30, 1, [0.5, None]), (40, 1, [math.nan] * 6), (50, 1, [math.inf] * 6), (60, 1, []), (70, 2, [0.6, 0.2]), (80, 2, [0.5] * 9)]
    rows += [rows[0], rows[10], rows[11], (20, 3, [0.9] * 6), (7, 0, [-3.0] * 6)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank int, window int")
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == [] and found(docs.where("vec_id = 11")) == []
