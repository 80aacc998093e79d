"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers stands first or last in it. Whether it is
chosen depends on the k-mer alone (no window around it), so the same passage yields the same anchors in any context, and
their positions can be matched. The fingerprint of a text is the list of all its anchors, however long it is, each as
"hash.position" in hexadecimal, ordered by hash and position.

Likeness compares all anchors of two texts: those of equal hash that follow each other in the same order in both (a chain
of ascending positions, over any number of diagonals), twice their number as a share of the anchors of both texts; this
is about the share of common text. What both texts have alike at their starts and ends is taken as it stands. Between,
an anchor that comes several times in a text is matched by its number of occurrence there; in texts with both repeated
and inserted passages the chain can so be shorter than the longest common sequence, never longer.

Cases: a null text is empty; an empty text has the fingerprint "" and is like another empty text only; a text shorter
than k has one anchor, the whole text; equal texts have equal fingerprints; repeated ids are ordered by their text,
a null id comes last; columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import map_arrow, tasks_for, without
from marlspike.llm.textvec import mix

K, S = 12, 4
#: Characters that are hashed at once.
CHUNK = 1 << 21

#: Rows that one range of ids should hold, and the largest number of ranges (its heads are broadcast: 16 bytes each).
RANGE_ROWS, MAX_RANGES = 100, 200_000
#: Rows that a task gets at most on average.
TASK_ROWS = 25_000


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and 32-bit hash of each anchor of the texts, in order of text and position."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = len(codes)
    numbers, positions, hashes = [], [], []
    if n >= k:
        # s-mers: a polynomial of the code points, mixed; the minimum over the k - s + 1 s-mers of each k-mer by doubling
        poly = np.zeros(n - s + 1, np.uint32)
        for i in range(s):
            poly = poly * np.uint32(0x9E3779B1) + codes[i : n - s + 1 + i]
        poly ^= poly >> np.uint32(16)
        poly *= np.uint32(0x85EBCA6B)
        poly ^= poly >> np.uint32(13)
        width = k - s + 1
        low, reach = poly, 1
        while reach < width:
            step = min(reach, width - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        m = n - k + 1
        at = np.flatnonzero((poly[:m] == low[:m]) | (poly[width - 1 : width - 1 + m] == low[:m]))
        owner = np.searchsorted(offsets, at, side="right") - 1
        inside = at + k <= offsets[owner + 1]
        at, owner = at[inside], owner[inside]
        value = np.zeros(len(at), np.uint64)
        for i in range(0, k, s):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + poly[at + min(i, k - s)].astype(np.uint64))
        numbers, positions, hashes = [owner], [at - offsets[owner]], [(value >> np.uint64(32)).astype(np.uint32)]
    short = np.flatnonzero((lengths < k) & (lengths > 0))
    if len(short):
        numbers.append(short)
        positions.append(np.zeros(len(short), np.int64))
        hashes.append(np.array([int.from_bytes(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:4], "little") for i in short], np.uint32))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(numbers), np.concatenate(positions), np.concatenate(hashes)


Sketch = tuple[np.ndarray, np.ndarray]


def sketches(texts: list[str], k: int = K, s: int = S) -> list[Sketch]:
    """For each text the hashes of its anchors and their positions, ascending by position."""
    out: list[Sketch] = []
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) <= CHUNK):
            chars += len(texts[last])
            last += 1
        number, position, hashed = anchors(texts[first:last], k, s)
        # anchors come in order of text and position; those of short texts, one each, stand behind the others
        order = np.argsort(number, kind="stable")
        number, position, hashed = number[order], position[order], hashed[order]
        limits = np.searchsorted(number, np.arange(last - first + 1))
        out += [(hashed[a:b], position[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
        first = last
    return out


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def to_texts(found: list[Sketch]) -> list[str]:
    """The fingerprint of each sketch; digits are set for all anchors at once."""
    sizes = np.array([len(h) for h, _ in found], np.int64)
    if not sizes.sum():
        return [""] * len(found)
    hashes, positions = np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found]).astype(np.uint32)
    order = np.lexsort((hashes, np.repeat(np.arange(len(found)), sizes)))
    hashes, positions = hashes[order], positions[order]
    width = max(1, -(-int(positions.max()).bit_length() // 4))
    digits = lambda values, n: _HEX[(values[:, None] >> np.arange(4 * (n - 1), -1, -4, dtype=np.uint32)).astype(np.uint8) & 15]
    cells = np.empty((len(hashes), 10 + width), np.uint8)
    cells[:, :8], cells[:, 8], cells[:, 9 : 9 + width], cells[:, -1] = digits(hashes, 8), ord("."), digits(positions, width), ord(",")
    # leading zeros of positions go
    lengths = np.ones(len(hashes), np.int64)
    shown = np.ones(cells.shape, bool)
    for n in range(1, width):
        there = positions >> np.uint32(4 * n) > 0
        shown[:, 8 + width - n] = there
        lengths += there
    flat = cells[shown].tobytes().decode("ascii")
    ends = np.concatenate([[0], np.cumsum(lengths + 10)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [flat[a : max(a, z - 1)] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def to_text(sketch: Sketch) -> str:
    return to_texts([sketch])[0]


def from_text(fingerprint: str) -> Sketch:
    both = [x.split(".") for x in fingerprint.split(",")] if fingerprint else []
    hashes, positions = np.array([int(h, 16) for h, _ in both], np.uint32), np.array([int(p, 16) for _, p in both], np.int64)
    order = np.argsort(positions, kind="stable")
    return hashes[order], positions[order]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes the two have alike from the start on."""
    n = min(len(a), len(b))
    apart = a[:n] != b[:n]
    return int(np.argmax(apart)) if apart.any() else n


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of occurrence as one word each, ascending, and their places."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.arange(len(ordered)) - np.repeat(new, np.diff(np.append(new, len(ordered))))
    return (ordered.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64), order


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Anchors that the hashes a and b, each in order of position, have in the same order."""
    start = _alike(a, b)
    a, b = a[start:], b[start:]
    end = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return start + end
    (key_a, at_a), (key_b, at_b) = _numbered(a), _numbered(b)
    _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    places = at_b[ib][np.argsort(at_a[ia])]
    if (places[1:] > places[:-1]).all():
        return start + end + len(places)
    # the longest ascending run of places: the least last place of a run of each length
    least: list[int] = []
    for p in places.tolist():
        i = bisect_left(least, p)
        least[i : i + 1] = [p]
    return start + end + len(least)


def likeness(a: Sketch, b: Sketch) -> float:
    """0 to 1; 1 for equal sketches."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    return 2 * chain(a[0], b[0]) / (len(a[0]) + len(b[0]))


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text."""
    df = without(df, to)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for first in range(0, len(texts), 512):
                rows = batch.slice(first, 512)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to_texts(sketches(texts[first : first + 512])), pa.string())], names=[*rows.schema.names, to])

    return map_arrow(df, run, schema)


def anchor_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each anchor: key, position, anchor (hash). For positional joins between documents."""
    schema = T.StructType([df.schema[key], T.StructField("position", T.LongType()), T.StructField("anchor", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for first in range(0, len(texts), 64):
                number, position, hashed = anchors(texts[first : first + 64])
                order = np.lexsort((position, number))
                keys = batch.column(key).slice(first, 64).take(pa.array(number[order]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(position[order]), pa.array(hashed[order].astype(np.int64))], names=[key, "position", "anchor"])

    return map_arrow(df.select(key, text), run, schema)


def _range_of(key: Column, cuts: list[int], parts: int) -> Column:
    """A number that ascends with key: an interval between two cuts (a balanced tree of comparisons), split evenly into parts."""

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            width = max(1, -(-(cuts[high] - cuts[low] + 1) // parts))
            inner = F.least(F.greatest(F.floor((key - F.lit(cuts[low])) / F.lit(width)), F.lit(0)), F.lit(parts - 1))
            return (F.lit(low * parts) + inner).cast("long")
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), tree(low, middle)).otherwise(tree(middle, high))

    return tree(0, len(cuts) - 1)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Column, int]:
    """df dealt into ranges of the integer key: a column _range, and a copy of each range's first row for the range before it
    (_copy true; that of the first range goes to the last one). Sorted by the returned order, each row's successor follows
    it within its range. One shuffle of the rows; the cut points and heads come from the keys alone. Ranges are small, so
    that partitions of many get about the same. Also returned: the number of rows.
    """
    spark = df.sparkSession
    keys = df.select(key)
    rows, low, high = keys.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    ranges = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    if low is None:
        placed = F.lit(0).cast("long")
    else:
        quantiles = min(ranges, 256)
        cuts = keys.agg(F.percentile_approx(key, [i / quantiles for i in range(1, quantiles)] or [0.5], 10_000)).first()[0]
        cuts = sorted({low, *(c for c in cuts if c is not None), high + 1})
        inner = max(1, ranges // quantiles)
        # nulls have a range of their own, the last: least() and greatest() would skip them
        placed = F.when(F.col(key).isNotNull(), _range_of(F.col(key), cuts, inner)).otherwise(F.lit(len(cuts) * inner).cast("long"))
    # the heads are as many as the ranges, at most MAX_RANGES plus one
    heads = sorted(((r[0], r[1]) for r in keys.groupBy(placed.alias("r")).agg(F.min(key)).collect()), key=lambda x: x[0])
    before = [(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    small = F.broadcast(spark.createDataFrame(before, f"_range long, _head {df.schema[key].dataType.simpleString()}, _before long"))
    ranged = df.withColumn("_range", placed)
    # of rows without a key the one with the least text is the head
    null_head = df.where(F.col(key).isNull()).agg(F.min_by(F.xxhash64(text), text)).first()[0]
    is_head = (ranged[key] == small["_head"]) | (ranged[key].isNull() & small["_head"].isNull() & (F.xxhash64(ranged[text]) == F.lit(null_head)))
    joined = ranged.join(small, (ranged["_range"] == small["_range"]) & is_head, "left").drop(small["_range"])
    both = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("c")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("c")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("c")))
    )
    out = joined.withColumn("_to", F.explode(both)).select(*df.columns, F.col("_to.r").alias("_range"), F.col("_to.c").alias("_copy"))
    return out, F.col("_range"), rows


def successor_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """For each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last n_chars // share code points by the first as many (or all) of the next row's text.
    """
    dealt, by, rows_in = with_next(docs.select(key, F.coalesce(text, F.lit("")).alias(text)), key, text)
    ordered = dealt.repartition(tasks_for(docs.sparkSession, rows_in, TASK_ROWS), by).sortWithinPartitions("_range", "_copy", F.col(key).asc_nulls_last(), text)
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())))])

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(text).to_pylist()
                yield from zip(part.column(key).to_pylist(), texts, part.column("_range").to_pylist(), part.column("_copy").to_pylist(), sketches(texts), strict=True)

    def run(batches):
        waiting: list[tuple] = []
        done: list[list] = []

        def flush():
            edited = sketches([w[2] for w in waiting])
            shown, shown_edited = to_texts([w[3] for w in waiting]), to_texts(edited)
            for (doc, own, changed, sketch, following), e, a, b in zip(waiting, edited, shown, shown_edited, strict=True):
                done.append([doc, len(own), hashlib.sha256(changed.encode()).hexdigest(), a, b, likeness(sketch, e), likeness(sketch, following)])
            waiting.clear()
            out = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        names, kinds = schema.names, [pa.int64() if isinstance(schema[key].dataType, T.LongType) else pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, closed = None, None
        chars = 0
        for row in rows(batches):
            if held is not None and row[2] == held[2] and closed != row[2]:
                cut = len(held[1]) // share
                waiting.append((held[0], held[1], held[1][: len(held[1]) - cut] + row[1][:cut], held[4], row[4]))
                chars += len(held[1])
                if row[3]:
                    closed = row[2]  # the first copy is the successor; more copies come from repeated ids
            held = row
            if chars > CHUNK or len(waiting) >= 512:
                yield flush()
                chars = 0
        if waiting:
            yield flush()

    return map_arrow(ordered, run, schema)
