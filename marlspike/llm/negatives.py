"""Hard negatives by distributed radix selection.

Rows are (vec_id, label, embedding); a component x counts as floor(256 * x), a score is the integer inner product with an
anchor. A window is a range of scores for one anchor, over rows of its label (for positives) or of other labels (for
negatives). The k best rows of a window are found without moving scores:

1. Each task counts, for each window, the scores by DIGITS equal buckets of the range, from the top, as far as its own k-th score; the
   counts are added in Spark, and the bucket that holds the k-th score becomes the window's range. This is repeated, digit by
   digit, until the range is a single score, the k-th itself.
2. One last pass gathers the rows above that score and, of those at it, the smallest ids that are still wanted.

Anchors are taken in blocks of a fixed number of components (BLOCK_VALUES); a block is broadcast and goes against all rows. So a
task's memory, the broadcasts and what comes to the driver depend on the block and not on the rows, however many rows share a
label, a vector or a score.

Cases. Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of different lengths: missing
components count as 0. Vectors whose inner products may exceed 2^62 fail with a message. Repeated rows
count as often as they stand, but an anchor that stands several times with the same label and vector is one anchor. Rows with the
anchor's own id are never its positives. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import fresh_path, map_arrow, table

#: Components of the anchors of one block.
BLOCK_VALUES = 1 << 18
#: Buckets of one radix digit.
DIGITS = 128
#: Scores of a piece of rows against a block that are held at once.
PIECE_SCORES = 1 << 21
POSITIVES, NEGATIVES = 5, 5
SCALE = 256


def quantised(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and q, the components as integers, of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(F.coalesce(x, F.array()), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("q"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The components as rows of a matrix, filled up with 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - offsets[row]] = values
    return out


class Block:
    """Anchors and their windows: for each window its anchor's place, the range of scores low to high, and how many rows are wanted."""

    def __init__(self, ids, labels, vectors, same_label, exact_in_doubles):
        self.ids, self.labels, self.same_label = ids, labels, same_label
        self.vectors = vectors.astype(np.float64 if exact_in_doubles else np.int64)
        self.anchor = self.low = self.high = self.wanted = self.at = None

    def with_windows(self, anchor, low, high, wanted, bound=None):
        """The same anchors with these windows; bound, the least score that is wanted, where it is known."""
        out = object.__new__(Block)
        out.__dict__.update(self.__dict__)
        out.anchor, out.low, out.high, out.wanted, out.at = anchor, low, high, wanted, bound
        return out

    def scored(self, batch: pa.RecordBatch):
        """Pieces of the batch: ids, scores of each anchor, and whether the row may stand in the anchor's windows."""
        step = max(1, PIECE_SCORES // max(1, len(self.ids)))
        for first in range(0, batch.num_rows, step):
            rows = batch.slice(first, step)
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            q = _matrix(rows.column("q"), self.vectors.shape[1]).astype(self.vectors.dtype)
            scores = (self.vectors @ q.T).astype(np.int64)
            same = self.labels[:, None] == labels[None, :]
            yield ids, scores, same & (self.ids[:, None] != ids[None, :]) if self.same_label else ~same


def _pieces_of_windows(n: int, rows: int):
    step = max(1, PIECE_SCORES // max(1, rows))
    return ((a, min(n, a + step)) for a in range(0, n, step))


def _histograms(rows: DataFrame, shared) -> DataFrame:
    """window, wanted, digit, n: counts of scores by buckets of each window's range from the top, as far as a task's own scores can matter."""

    def run(batches):
        block = shared.value
        n = len(block.anchor)
        width = (block.high - block.low) // DIGITS + 1
        counts = np.zeros(n * DIGITS, np.int64)
        for batch in batches:
            for _, scores, allowed in block.scored(batch):
                for a, b in _pieces_of_windows(n, scores.shape[1]):
                    s, who = scores[block.anchor[a:b]], block.anchor[a:b]
                    inside = allowed[who] & (s >= block.low[a:b, None]) & (s <= block.high[a:b, None])
                    window, column = np.nonzero(inside)
                    digit = (block.high[a + window] - s[window, column]) // width[a + window]
                    counts[a * DIGITS : b * DIGITS] += np.bincount(window * DIGITS + digit, minlength=(b - a) * DIGITS)
        counts = counts.reshape(n, DIGITS)
        above = np.cumsum(counts, axis=1) - counts
        window, digit = np.nonzero((counts > 0) & (above < block.wanted[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(counts[window, digit]), pa.array(block.wanted[window])], names=["window", "digit", "n", "wanted"])

    return map_arrow(rows, run, "window int, digit int, n long, wanted long").groupBy("window", "wanted", "digit").agg(F.sum("n").alias("n"))


def _refined(rows: DataFrame, block: Block) -> Block:
    """The block with the bound of each window: its k-th score, or its lower limit where there are fewer rows."""
    spark = rows.sparkSession
    low, high, left = block.low.copy(), block.high.copy(), block.wanted.copy()
    open_ = np.flatnonzero(high > low)
    while len(open_):
        shared = spark.sparkContext.broadcast(block.with_windows(block.anchor[open_], low[open_], high[open_], left[open_]))
        by_window = Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counted = _histograms(rows, shared).withColumn("above", F.coalesce(F.sum("n").over(by_window), F.lit(0)))
        # the bucket of the k-th score: fewer than wanted above it, and enough with it
        found = counted.where("above < wanted and above + n >= wanted").select("window", "digit", "above").toPandas()
        shared.unpersist()
        hit = np.zeros(len(open_), bool)
        hit[found["window"]] = True
        low_before = low[open_]
        # fewer rows than wanted: the whole range qualifies
        high[open_[~hit]] = low_before[~hit]
        at, digit = open_[found["window"].to_numpy()], found["digit"].to_numpy(np.int64)
        width = (high[at] - low[at]) // DIGITS + 1
        top = high[at] - digit * width
        low[at], high[at] = np.maximum(low[at], top - width + 1), top
        left[at] -= found["above"].to_numpy(np.int64)
        open_ = open_[high[open_] > low[open_]]
    return block.with_windows(block.anchor, block.low, block.high, block.wanted, low)


def _gathered(rows: DataFrame, block: Block) -> DataFrame:
    """window, score, vec_id, rank: the wanted rows of each window, higher scores first, ties by smaller id."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block = shared.value
        n, most = len(block.anchor), int(block.wanted.max(initial=1))
        ids_at = [[] for _ in range(n)]  # of each window the ids at the bound: no more than are wanted
        for batch in batches:
            out = ([], [], [])
            for ids, scores, allowed in block.scored(batch):
                for a, b in _pieces_of_windows(n, scores.shape[1]):
                    s, who = scores[block.anchor[a:b]], block.anchor[a:b]
                    inside = allowed[who] & (s >= block.at[a:b, None]) & (s <= block.high[a:b, None])
                    window, column = np.nonzero(inside)
                    above = s[window, column] > block.at[a + window]
                    for values, column_of in zip((window[above] + a, s[window[above], column[above]], ids[column[above]]), out):
                        column_of.append(values)
                    window, its = window[~above], ids[column[~above]]
                    order = np.lexsort((its, window))
                    window, its = window[order], its[order]
                    place = np.arange(len(window)) - np.searchsorted(window, window)
                    for w, i in zip((window[place < most] + a).tolist(), its[place < most].tolist()):
                        ids_at[w].append(i)
                        if len(ids_at[w]) > 4 * most:
                            ids_at[w] = sorted(ids_at[w])[:most]
            if out[0] and sum(map(len, out[0])):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, (np.int32, np.int64, np.int64))], names=["window", "score", "vec_id"])
        for w in range(n):
            if ids_at[w]:
                its = sorted(ids_at[w])[: int(block.wanted[w])]
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(its), pa.int32()), pa.array([int(block.at[w])] * len(its), pa.int64()), pa.array(its, pa.int64())], names=["window", "score", "vec_id"])

    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
    most = int(block.wanted.max(initial=1))
    return map_arrow(rows, run, "window int, score long, vec_id long").withColumn("rank", place).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], low: int = 80, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (is_anchor of vec_id) and each of its best rows of the same label, the best rows of other labels that score from low
    per cent of the positive's score up to that score.
    """
    spark = rows.sparkSession
    vectors = table(quantised(rows, F.col("label") if label is None else label), "vectors")
    norm = F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    size = vectors.agg(F.count_if(is_anchor(F.col("vec_id"))).alias("anchors"), F.max(F.size("q")).alias("width"), F.max(norm).alias("norm")).first()
    width, reach = size["width"] or 0, int((size["norm"] or 0) * (1 + 1e-9))  # no inner product exceeds the largest square of a norm
    if reach >= 1 << 62:
        raise ValueError("the inner products of these vectors don't fit a long")
    path = fresh_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    per_block = max(1, BLOCK_VALUES // max(1, width))
    blocks = -(-size["anchors"] // per_block)
    anchors = table(vectors.where(is_anchor(F.col("vec_id"))).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(max(1, blocks)))), "anchors")
    for number in range(blocks):
        found = anchors.where(F.col("block") == number).select("vec_id", "label", "q").toArrow()
        if found.num_rows:
            _mine_block(vectors, found, width, reach, low, positives, negatives).write.parquet(f"{path}/block={number}")
    if not blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").option("basePath", path).parquet(path).drop("block")


def _mine_block(vectors: DataFrame, found: pa.Table, width: int, reach: int, low: int, positives: int, negatives: int) -> DataFrame:
    spark = vectors.sparkSession
    ids, labels = (found.column(c).to_numpy() for c in ("vec_id", "label"))
    block = Block(ids, labels, _matrix(found.column("q"), width), True, reach < 1 << 53)
    n = len(ids)
    own = block.with_windows(np.arange(n), np.full(n, -reach), np.full(n, reach), np.full(n, positives))
    best = _gathered(vectors, _refined(vectors, own)).toPandas()  # at most so many rows: the anchors of a block times the positives
    anchor, score, positive = best["window"].to_numpy(np.int64), best["score"].to_numpy(np.int64), best["vec_id"].to_numpy(np.int64)
    # low * p <= 100 * s <= 100 * p; no such score where p is negative
    pairs = score >= 0
    anchor, score, positive = anchor[pairs], score[pairs], positive[pairs]
    least = np.array([-(-low * p // 100) for p in score.tolist()], np.int64)
    block.same_label = False
    ranges = block.with_windows(anchor, least, score, np.full(len(anchor), negatives))
    mined = _gathered(vectors, _refined(vectors, ranges))
    named = spark.createDataFrame(pa.table({"window": pa.array(np.arange(len(anchor)), pa.int32()), "anchor_id": pa.array(ids[anchor], pa.int64()), "positive_id": pa.array(positive, pa.int64()), "positive_score": pa.array(score, pa.int64())}))
    return mined.join(F.broadcast(named), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
