"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprints that differ in at most DISTANCE = 3 of 64 bits are linked; a group is a connected component. Equal texts
meet in one fingerprint first, so only different fingerprints are compared.

Buckets: of four blocks of bits at least one is equal in two linked fingerprints, so each fingerprint goes to the
buckets of its four blocks. Buckets of more than BUCKET fingerprints are dealt out again by four blocks of the bits that
are still free, up to four times; then at most 2**21 different fingerprints can share a bucket. Nothing is dropped.

Index: within a bucket fingerprints are sorted by Gray rank, so that neighbours share bit patterns. Leaves of LEAF
fingerprints and nodes of FAN children keep the bits that all below have in common. A join of the tree with itself goes
down pairs of nodes and prunes a pair as soon as the common bits of the two differ in more than three places. What a
bucket returns are links from each fingerprint to the smallest one that it reaches there: no pairs within a group.

Components: alternating large and small stars over the links, a written table for each round.

Cases: a null text is empty; texts without words have fingerprint zero and are linked like others; null ids take part
and never name a component (a component of null ids alone has a null name); repeated rows are kept; an empty table gives
an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import map_arrow, table, tasks_for, without

SHINGLE, DISTANCE, SEED = 3, 3, 42
BUCKET, LEAF, FAN = 4_096, 16, 8
#: Node or item pairs that are looked at in one step of a join.
PAIRS = 1 << 20
#: Fingerprints in their buckets that a task gets at most on average.
TASK_ROWS = 2_000_000
#: Shingles whose bits are summed at once.
SUM_AT_ONCE = 1 << 17


def text_fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in zip(*[words[i:] for i in range(shingle)])), np.uint64, len(words) - shingle + 1)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), SUM_AT_ONCE):
        bits = np.unpackbits(hashes[first : first + SUM_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", to: str = "simhash", keep_text: bool = False) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    docs = without(docs, to)
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(to, T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(text)
            found = np.fromiter((text_fingerprint(texts[i].as_py() or "") for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found.view(np.int64))], names=[*kept, to])

    return map_arrow(docs, run, schema)


def _level_masks(levels: int = 4) -> list[list[int]]:
    """For each level the fixed bits of each path of blocks: path * 4 + block at the next level."""
    out, paths = [], [0]
    for _ in range(levels):
        below = []
        for fixed in paths:
            free = [b for b in range(64) if not fixed >> b & 1]
            limits = [len(free) * i // 4 for i in range(5)]
            below += [fixed | sum(1 << b for b in free[a:z]) for a, z in zip(limits[:-1], limits[1:], strict=True)]
        out.append(below)
        paths = below
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """The place of a word in the order of Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of each i and j; label points to a smaller member, roots to themselves."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def bucket_links(bucket: np.ndarray, fp: np.ndarray, distance: int = DISTANCE, pairs: int = PAIRS) -> np.ndarray:
    """For rows sorted by bucket and Gray rank: the number of the smallest row that each is linked to within its bucket."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(first, n))
    # levels of nodes, from the items up: bits that are one, or zero, in all below, and limits of the children
    ones, zeros = [fp], [~fp]
    starts: list[np.ndarray] = [np.arange(n + 1)]
    counts, offset, fan = sizes, first, LEAF
    while counts.max() > 1:
        place = np.arange(len(ones[-1])) - np.repeat(offset, counts)
        begin = np.flatnonzero(place % fan == 0)
        starts.append(np.append(begin, len(ones[-1])))
        ones.append(np.bitwise_and.reduceat(ones[-1], begin))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], begin))
        counts = -(-counts // fan)
        offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
        fan = FAN
    top = len(ones) - 1
    roots = np.arange(len(ones[top]))
    if top:
        many = np.diff(starts[top]) > 0
        roots = roots[many]
    waiting = [(top, roots, roots)]
    while waiting:
        level, a, b = waiting.pop()
        if level == 0:
            _union(label, a, b)
            continue
        limits = starts[level]
        wide = (limits[a + 1] - limits[a]) * (limits[b + 1] - limits[b])
        cut = np.searchsorted(np.cumsum(wide), pairs, side="right") + 1
        if cut < len(a):
            waiting.append((level, a[cut:], b[cut:]))
            a, b, wide = a[:cut], b[:cut], wide[:cut]
        pair = np.repeat(np.arange(len(a)), wide)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(wide) - wide, wide)
        columns = (limits[b + 1] - limits[b])[pair]
        left, right = limits[a][pair] + inner // columns, limits[b][pair] + inner % columns
        upper = (left < right) if level == 1 else (left <= right)
        left, right = left[upper], right[upper]
        below = level - 1
        apart = np.bitwise_count((ones[below][left] & zeros[below][right]) | (zeros[below][left] & ones[below][right]))
        near = apart <= distance
        if near.any():
            waiting.append((below, left[near], right[near]))
    return label


def _links(rows: DataFrame) -> DataFrame:
    """u, v (signed fingerprints, v the smaller row in the bucket's order) from rows (bucket, gray, fp)."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches):
        held_bucket, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(bucket, fp):
            label = bucket_links(bucket, fp.view(np.uint64))
            u = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[label[u]])], names=["u", "v"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            waiting.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()))
            size += batch.num_rows
            if size >= 200_000:
                bucket, fp = (np.concatenate([held, *(w[k] for w in waiting)]) for k, held in enumerate((held_bucket, held_fp)))
                waiting, size = [], 0
                open_from = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if bucket[0] != bucket[-1] else 0
                if open_from:
                    yield links(bucket[:open_from], fp[:open_from])
                held_bucket, held_fp = bucket[open_from:], fp[open_from:]
        bucket, fp = (np.concatenate([held, *(w[k] for w in waiting)]) for k, held in enumerate((held_bucket, held_fp)))
        if len(fp):
            yield links(bucket, fp)

    return map_arrow(rows, run, schema)


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links between different fingerprints of nodes (fp), enough to connect all that are within DISTANCE."""
    spark = nodes.sparkSession
    masks = _level_masks()
    rows = nodes.select("fp", F.lit(0).alias("path"))
    ready: list[DataFrame] = []
    for level, level_masks in enumerate(masks):
        fixed = F.array(*[F.lit(_signed(m)) for m in level_masks])
        child = rows.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("path", F.col("path") * 4 + F.col("block"))
        child = child.select("fp", "path", F.xxhash64(F.lit(level), "path", F.col("fp").bitwiseAND(F.get(fixed, F.col("path")))).alias("bucket"))
        if level == len(masks) - 1:
            ready.append(child)
            break
        crowded = table(child.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket"), "simhash-crowded")
        if crowded.isEmpty():
            ready.append(child)
            break
        ready.append(child.join(crowded, "bucket", "left_anti").select("fp", "path", "bucket"))
        rows = child.join(crowded, "bucket", "left_semi").select("fp", "path")
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    n = tasks_for(spark, 4 * nodes.count(), TASK_ROWS)
    ordered = dealt.select("bucket", "fp", gray_rank(F.col("fp")).alias("gray")).repartition(n, "bucket").sortWithinPartitions("bucket", "gray")
    return _links(ordered.select("bucket", "fp"))


def connected(links: DataFrame) -> DataFrame:
    """node, label: for each node of links (u, v) the smallest node of its component."""
    edges = table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-edges")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        # large star: every node hands its larger neighbours to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, "simhash-large")
        # small star: every node hands its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = table(small, "simhash-edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def components(found: DataFrame, key: str = "doc_id", fp: str = "simhash") -> DataFrame:
    """found (a row for each document, written so that it's the same each time) with component_id, the smallest key reached."""
    found = without(found, "component_id")
    nodes = table(found.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "simhash-nodes")
    labels = connected(near_links(nodes.select("fp")))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = table(named, "simhash-labels")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "label").join(smallest, "label").select(F.col("fp").alias("_fp"), "component_id")
    return found.join(of_fp, found[fp] == of_fp["_fp"]).drop("_fp")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each component: that of its smallest id. Rows without an id aren't judged and stay; of rows that have one id
    one stays, any of them where their texts differ."""
    found = table(fingerprints(docs.where(F.col(key).isNotNull()).select(key, text), text), "simhash-found")
    kept = components(found, key).where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi").dropDuplicates([key])
    return named.select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
