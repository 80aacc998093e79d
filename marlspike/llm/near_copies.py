"""Near copies by the Jaccard similarity of word shingles, exact: every pair of at least 4 / 5 counts.

A text's set holds the 64-bit hashes of its SHINGLE-word runs (all its words where they are fewer). Rows of equal sets are
one node; nodes of similarity 4 / 5 or more are linked, and a group is a connected component.

First the SimHash index (simhash.near_links) proposes: fingerprints of the sets, linked in its Gray-order tree, pair each
node with the smallest of its component. At this similarity fingerprints differ in about ten bits, more than an index of
64 bits can be searched for, so the links that it can't see are found by prefixes: with all sets in one common order, two
sets of at least that similarity share one of the first n - ceil(4 n / 5) + 1 members of each. The order puts what a
sample of texts has often last, then goes by hash; any order gives the same groups, this one keeps buckets of the same
leading member small.

Rounds of links. First the index's pairs, and every bucket's nodes with its smallest one, so that a group of many
copies costs no pairs within itself. Then the pairs of a bucket that are not yet connected, but those whose sizes, places
in the order or parity bitmaps rule it out: each node with its nearest others by bitmap, NEAREST in the first of these
rounds and MORE times as many in each further one. Groups grow together meanwhile, which settles most other pairs; the
buckets that had more come again until none has, so no pair is left out. Each pair is compared by parity sketches as long as
the sets, which rule out most of the unlike ones, then by its whole sets. A member that the sample has often is dealt out by
a salt of its nodes, in parts of about BUCKET; in the later rounds as pairs of such parts.

Texts aren't shuffled but where they are needed: rows are looked up in a bit filter of the wanted ones first (maybe_in).

Cases: a null text is empty; texts without words are copies of each other; rows without an id aren't judged and stay;
rows of one id with different texts are judged one by one, of equal ones (id and text) one stays; a very long text has a
set like others; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm import textvec
from marlspike.llm.common import discard, map_arrow, table, tasks_for
from marlspike.llm.simhash import connected, near_links

SHINGLE = 5
#: Rows that the sample for the order takes at most, and members that it may put last: these bound work, not results.
SAMPLE_ROWS, COMMON = 8_192, 65_536
#: Pairs in one batch of candidates, and nodes of a bucket that one task compares with as many others.
PAIRS, BUCKET = 1 << 16, 4_096
#: Bits of the parity bitmap of a set; sets differ in at least as many members as their bitmaps do in bits.
BITMAP = 256
WORDS = BITMAP // 64
#: Others that a node is paired with in each bucket of the second round, and the factor from each round to the next.
NEAREST, MORE = 2, 16
#: Bits of a filter for each row in it, in blocks, and at most (32 MB); beyond that it lets more rows pass, which an exact join drops.
FILTER_BITS, FILTER_BLOCK, FILTER_MOST = 64, 1 << 15, 1 << 28
#: Bytes of text whose sets are made at once.
SLICE = 1 << 20
#: Texts whose prefixes a task gets at most on average.
TASK_ROWS = 25_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending within it, and the rows' offsets."""
    h, at = textvec.words(data, offsets)
    n = np.diff(at)
    row = textvec.row_of(at)
    run, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= shingle:
        m = len(h) - shingle + 1
        run = np.zeros(m, np.uint64)
        for i in range(shingle):
            run = textvec.mix(run * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
        inside = row[:m] == row[shingle - 1 :]
        run, rows = run[inside], row[:m][inside]
    # texts of fewer words: all of them
    short = np.flatnonzero((n > 0) & (n < shingle))
    few = np.zeros(len(short), np.uint64)
    for i in range(shingle - 1):
        more = n[short] > i
        few[more] = textvec.mix(few[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[short[more]] + i])
    run, rows = np.concatenate([run, textvec.mix(few + n[short].astype(np.uint64))]), np.concatenate([rows, short])
    order = np.lexsort((run, rows))
    run, rows = run[order], rows[order]
    if len(run):
        first = np.concatenate([[True], (run[1:] != run[:-1]) | (rows[1:] != rows[:-1])])
        run, rows = run[first], rows[first]
    return run.view(np.int64), np.searchsorted(rows, np.arange(len(at)))


def _per_row(values: np.ndarray, limits: np.ndarray, reduce) -> np.ndarray:
    """reduce.reduceat over the rows of values (zero for rows without any)."""
    out = np.zeros((len(limits) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(limits) > 0)
    if len(some):
        out[some] = reduce.reduceat(values, limits[:-1][some], axis=0)
    return out


def node_of(members: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = _per_row(textvec.mix(members.view(np.uint64) ^ np.uint64(0xA24BAED4963EE407)), limits, np.add)
    return textvec.mix(sums + np.diff(limits).astype(np.uint64)).view(np.int64)


def fingerprint_of(members: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if set in over half the members."""
    out = np.zeros((len(limits) - 1, 8), np.uint8)
    step = max(1, int(len(limits) * (1 << 17) // max(1, len(members))))
    for first in range(0, len(limits) - 1, step):
        part = limits[first : first + step + 1]
        bits = np.unpackbits(members[part[0] : part[-1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        ones = _per_row(bits, part - part[0], np.add)
        out[first : first + len(part) - 1] = np.packbits(2 * ones > np.diff(part)[:, None], axis=1, bitorder="little")
    return out.view(np.int64).reshape(-1)


def bitmap_of(members: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set, as WORDS longs: bit b is the parity of the members that fall to b."""
    place = members.view(np.uint64) >> np.uint64(64 - BITMAP.bit_length() + 1)
    words = np.zeros((len(members), WORDS), np.uint64)
    words[np.arange(len(members)), (place >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (place & np.uint64(63))
    return _per_row(words, limits, np.bitwise_xor).view(np.int64)


def sketch_of(members: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps as long as the sets: bits by the low end of the members, BITMAP of them or the next power of two from the
    size on; longs, and the rows' offsets. One of twice the length is folded to another's by exclusive or of its halves."""
    n = np.diff(limits)
    bits = np.maximum(BITMAP, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(start[:-1], n) + (members & (np.repeat(bits, n) - 1))
    parity = (np.bincount(place, minlength=start[-1]) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64), start // 64


def _sets(docs: DataFrame, text: str, schema: str, columns) -> DataFrame:
    """docs without text, and what columns(members, limits) gives for the sets of each slice of rows."""
    kept = [c for c in docs.columns if c != text]
    names = [*kept, *(x.split()[0] for x in schema.split(", "))]
    full = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), schema])

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffers(batch.column(text))
            for first, last in textvec.slices(offsets):
                part = offsets[first : last + 1]
                found = columns(*shingle_sets(data[part[0] : part[-1]], part - part[0]))
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *found], names=names)

    return map_arrow(docs, run, full)


def with_members(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with members (array of longs, ascending)."""
    return _sets(docs, text, "members array<bigint>", lambda m, at: [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(m))])


def _common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Members that a sample's sets have several times, ascending, and how often."""
    often = with_members(docs.select(text), text).select(F.explode("members").alias("m")).groupBy("m").count().where("count > 1").orderBy(F.desc("count"), "m").limit(COMMON).collect()
    members = np.array([r["m"] for r in often], np.int64)
    order = np.argsort(members)
    return members[order], np.array([r["count"] for r in often], np.int64)[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], scale: float, text: str = "text") -> DataFrame:
    """member, salt, node, n (size of the set), at (place in the order) of the prefix of each text's set; the sets of a slice once.

    scale: rows for each row of the sample behind common.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        often, counts = sent.value
        deals = np.maximum(1, np.ceil(counts * scale / BUCKET)).astype(np.uint64)
        for batch in batches:
            data, offsets = textvec.text_buffers(batch.column(text))
            for first, last in textvec.slices(offsets, SLICE):
                part = offsets[first : last + 1]
                members, limits = shingle_sets(data[part[0] : part[-1]], part - part[0])
                n, node = np.diff(limits), node_of(members, limits)
                new = np.zeros(len(node), bool)
                new[np.unique(node, return_index=True)[1]] = True
                row = np.repeat(np.arange(len(n)), n)
                weight, deal = np.zeros(len(members), np.int64), np.ones(len(members), np.uint64)
                if len(often):
                    found = np.minimum(np.searchsorted(often, members), len(often) - 1)
                    known = often[found] == members
                    weight[known], deal[known] = counts[found[known]], deals[found[known]]
                order = np.lexsort((members, weight, row))
                at = np.arange(len(members)) - np.repeat(limits[:-1], n)
                inside = (at < (n - (4 * n + 4) // 5 + 1)[row]) & new[row]
                chosen, of = order[inside], row[inside]
                # -1: a member that is not dealt out
                salt = np.where(deal[chosen] > 1, (textvec.mix(node[of].view(np.uint64)) % deal[chosen]).astype(np.int64), -1).astype(np.int32)
                columns = [members[chosen], salt, node[of], n[of].astype(np.int32), at[inside].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["member", "salt", "node", "n", "at"])

    return map_arrow(docs.select(text), run, "member long, salt int, node long, n int, at int")


def shared_members(dealt: DataFrame) -> DataFrame:
    """Of rows (member, salt, node, n, at) in order of member, salt and node: those whose bucket may have another node, each once,
    with least, the smallest node of its member and salt. Dealt members are all kept: their other parts are elsewhere."""
    names = ("member", "salt", "node", "n", "at")

    def run(batches):
        held = [np.zeros(0, np.int64)] * len(names)

        def buckets(rows):
            member, salt, node = rows[:3]
            fresh = np.concatenate([[True], (member[1:] != member[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])])
            rows = [r[fresh] for r in rows]
            member, salt, node = rows[:3]
            first = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (salt[1:] != salt[:-1])]))
            sizes = np.diff(np.append(first, len(node)))
            kept = np.repeat((sizes > 1) | (salt[first] >= 0), sizes)
            least = np.repeat(node[first], sizes)
            return [r[kept] for r in (*rows, least)]

        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names, strict=True)]
            if len(rows[0]):
                cut = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if (rows[0][0] != rows[0][-1]) or (rows[1][0] != rows[1][-1]) else 0
                held = [r[cut:] for r in rows]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(r) for r in buckets([r[:cut] for r in rows])], names=[*names, "least"])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in buckets(held)], names=[*names, "least"])

    return map_arrow(dealt, run, "member long, salt long, node long, n long, at long, least long")


def possible(n: np.ndarray, at: np.ndarray, bitmap: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Whether sets that have their first common members at these places can reach 4 / 5: overlap o with 9 o >= 4 (n + m)."""
    both = n[i] + n[j]
    j = j[9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * both]
    apart = np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(axis=1, dtype=np.int64)
    return j[9 * (n[i] + n[j] - apart) >= 8 * (n[i] + n[j])]


def candidate_pairs(ordered: DataFrame, nearest: int) -> DataFrame:
    """u, v, rest of the possible pairs of each bucket whose labels differ, from rows (member, i, j, salt, label, node, n, at,
    bitmap) in order of member, i, j. A bucket of one part (i = j) has all its pairs, one of two those between them. A node has
    its nearest ones by bitmap; rest (with null u and v) names members whose buckets have more."""
    plain = ("member", "i", "j", "salt", "label", "node", "n", "at")

    def run(batches):
        found, size = [], 0
        rest: set[int] = set()

        def batch_of():
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["u", "v", "rest"])

        def rest_of():
            out = pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(list(rest), pa.int64())], names=["u", "v", "rest"])
            rest.clear()
            return out

        def bucket(member, rows):
            first, second, salt, label, node, n, at, bitmap = rows
            every = np.arange(len(node))
            for i in every:
                j = every[label != label[i]]
                if first[0] != second[0]:
                    j = j[salt[j] != salt[i]]
                j = possible(n, at, bitmap, i, j)
                if len(j) > nearest:
                    rest.add(int(member))
                    apart = np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(axis=1, dtype=np.int64)
                    j = j[np.argsort(apart, kind="stable")[:nearest]]
                if len(j):
                    yield np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], axis=1)

        def whole(rows):
            key = np.stack(rows[:3], axis=1)
            limits = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            for a, z in zip(limits[:-1], limits[1:], strict=True):
                if z - a > 1:
                    yield from bucket(rows[0][a], [r[a:z] for r in rows[1:]])

        held = [np.zeros(0, np.int64)] * len(plain) + [np.zeros((0, WORDS), np.uint64)]
        for batch in batches:
            new = [batch.column(c).to_numpy().astype(np.int64) for c in plain] + [batch.column("bitmap").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])) if len(held[0]) else np.zeros(0, np.int64)
            cut = int(other[-1]) + 1 if len(other) else 0
            for pairs in whole([h[:cut] for h in held]):
                found.append(pairs)
                size += len(pairs)
                if size >= PAIRS:
                    yield batch_of()
                    found, size = [], 0
            held = [h[cut:] for h in held]
            if len(rest) >= PAIRS:
                yield rest_of()
        for pairs in whole(held):
            found.append(pairs)
            size += len(pairs)
            if size >= PAIRS:
                yield batch_of()
                found, size = [], 0
        if found:
            yield batch_of()
        if rest:
            yield rest_of()

    return map_arrow(ordered.select(*plain, "bitmap"), run, "u long, v long, rest long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar by 4 / 5 or more."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def maybe_in(docs: DataFrame, wanted: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """docs with flag, true for each row whose columns a row of wanted (written) has, and for few others."""
    bits = FILTER_BLOCK
    while bits < min(FILTER_MOST, FILTER_BITS * wanted.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(*columns), F.lit(bits).cast("long"))
    block, bit = (place / FILTER_BLOCK).cast("int"), (place % FILTER_BLOCK).cast("int")
    at, inside, held = (f"_{name}_{len(max(docs.columns, key=len)) * '_'}" for name in ("block", "bit", "bits"))
    blocks = wanted.groupBy(block.alias(at)).agg(F.bitmap_construct_agg(bit).alias(held))
    marked = docs.withColumns({at: block, inside: bit}).join(F.broadcast(blocks), at, "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.col(inside) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.withColumn(flag, F.coalesce(F.getbit(byte, F.col(inside) % 8) == 1, F.lit(False))).drop(at, inside, held)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, same (a hash of the text) and component_id (the smallest key reached) of docs (with keys, the same each time they are read).

    Sets are made anew from the texts where they are needed, rather than written: they are larger than the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(key, F.coalesce(text, F.lit("")).alias(text)).withColumn("same", F.xxhash64(text))

    def facts(m, at):
        bitmap = pa.ListArray.from_arrays(pa.array((np.arange(len(at)) * WORDS).astype(np.int32)), pa.array(bitmap_of(m, at).reshape(-1)))
        longs, limits = sketch_of(m, at)
        sketch = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(longs))
        return [pa.array(node_of(m, at)), pa.array(np.diff(at)), pa.array(fingerprint_of(m, at)), bitmap, sketch]

    found = table(_sets(docs, text, "node bigint, size bigint, fp bigint, bitmap array<bigint>, sketch array<bigint>", facts), "near-found")
    # each node is stood for by one text
    nodes = table(found.groupBy("node").agg(F.min(F.struct(key, "same")).alias("one"), *(F.first(c).alias(c) for c in ("size", "fp", "bitmap", "sketch"))), "near-nodes")

    # what the SimHash index links: each node and the smallest of its component
    labels = connected(near_links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    named = table(nodes.select("node", "fp").join(labels, "fp", "left").select("node", F.coalesce("label", "fp").alias("label")), "near-index")
    by_index = named.join(named.groupBy("label").agg(F.min("node").alias("v")), "label").select(F.col("node").alias("u"), "v")

    # buckets of several nodes alone: most members belong to one node
    total = found.count()
    scale = max(1.0, total / SAMPLE_ROWS)
    common = _common(docs.where(F.pmod(F.xxhash64(key, "same"), F.lit(1_000_000)) < F.lit(int(1_000_000 / scale))), text)
    n = tasks_for(spark, total, TASK_ROWS)
    dealt = prefixes(docs, common, scale, text).repartition(n, "member", "salt").sortWithinPartitions("member", "salt", "node")
    shared = table(shared_members(dealt), "near-shared")
    by_part = shared.select(F.col("node").alias("u"), F.col("least").alias("v"))
    parts = shared.where("salt >= 0").select("member", "least").distinct()
    across = parts.join(parts.groupBy("member").agg(F.min("least").alias("v")), "member").select(F.col("least").alias("u"), "v")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that their whole sets confirm; sizes and sketches first."""
        small = nodes.select("node", "size", "sketch")
        both = pairs.where("u <> v").distinct()
        for side in ("u", "v"):
            both = both.join(small.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
        union = F.col("u_size") + F.col("v_size")
        both = both.where(9 * F.least("u_size", "v_size") >= 4 * union)
        xor = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
        half = F.least(F.size("u_sketch"), F.size("v_sketch"))
        # sizes are so near here that one is twice as long as the other at most
        folded = lambda c: F.when(F.size(c) > half, xor(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half))).otherwise(F.col(c))
        apart = F.aggregate(xor(folded("u_sketch"), folded("v_sketch")), F.lit(0), lambda a, x: a + F.bit_count(x))
        pairs = table(both.where(9 * (union - apart) >= 8 * union).select("u", "v"), "near-pairs")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        ones = table(nodes.select("node", "one").join(wanted, "node", "left_semi").select("node", "one.*"), "near-ones")
        near = maybe_in(docs, ones, [key, "same"], "_wanted").where("_wanted")
        sets = table(with_members(near.join(ones, [key, "same"]).select("node", text), text), "near-sets")
        # a row that stands twice gives its set twice
        links = table(_linked(pairs, sets).distinct(), "near-links")
        discard(sets, pairs, ones)
        return links

    links = similar(by_index.unionByName(by_part).unionByName(across))
    labels = connected(links)
    # parts of a dealt member meet in pairs; -1 alone is one part
    facing = F.explode(F.when(F.col("salts") < 0, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), "salts")))
    rows, nearest = shared.drop("least"), NEAREST
    while True:
        mixed = table(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
        several = mixed.groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("salt").alias("salts")).where("low <> high").select("member", "salts")
        open_rows = mixed.join(several, "member").join(nodes.select("node", "bitmap"), "node")
        paired = open_rows.withColumn("facing", facing).withColumns({"i": F.least("salt", "facing"), "j": F.greatest("salt", "facing")})
        ordered = paired.repartition(n, "member", "i", "j").sortWithinPartitions("member", "i", "j", "node")
        more = table(candidate_pairs(ordered, nearest), "near-more")
        discard(mixed)
        if more.isEmpty():
            discard(more)
            break
        links = links.unionByName(similar(more.where("rest is null").select("u", "v")))
        labels = connected(links)
        # what waits of other pairs
        rows = table(rows.join(more.where("rest is not null").select(F.col("rest").alias("member")).distinct(), "member", "left_semi"), "near-open")
        discard(more, shared)
        shared, nearest = rows, nearest * MORE
        if shared.isEmpty():
            break
    discard(shared)
    named = table(found.select(key, "same", "node").join(labels, "node", "left").select(key, "same", F.coalesce("label", "node").alias("label")), "near-named")
    discard(found, nodes)
    return named.join(named.groupBy("label").agg(F.min(key).alias("component_id")), "label").select(key, "same", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each component: that of its smallest id. Rows without an id aren't judged and stay."""
    known = docs.where(F.col(key).isNotNull())
    same = "_same"
    while same in docs.columns:
        same += "_"
    judged = table(components(known, key, text).select(key, F.col("same").alias(same), "component_id"), "near-judged")
    # texts of rows that surely stay aren't shuffled: alone with their id and text, and the smallest of their group
    doubtful = table(judged.groupBy(key, same).agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least")).where((F.col("n") > 1) | (F.col(key) != F.col("least"))).select(key, same), "near-doubtful")
    flag = same + "?"
    while flag in docs.columns:
        flag += "?"
    marked = maybe_in(known.withColumn(same, F.xxhash64(F.coalesce(text, F.lit("")))), doubtful, [key, same], flag)
    kept = judged.where(F.col(key) == F.col("component_id")).select(key, same).distinct()
    settled = marked.where(F.col(f"`{flag}`")).join(kept, [key, same], "left_semi").dropDuplicates([key, same])
    rest = marked.where(~F.col(f"`{flag}`"))
    return rest.select(docs.columns).unionByName(settled.select(docs.columns)).unionByName(docs.where(F.col(key).isNull()))
