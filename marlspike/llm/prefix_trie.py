"""Prefix trie of conversations: a row for each distinct sequence of first turns.

1. Turns become numbers: an order-preserving dictionary of the distinct (role, text) pairs, by 128-bit digests; texts don't travel.
2. Equal sequences become one, with the number of their conversations and the smallest, so that copies don't crowd a bucket.
3. Distributed MSD radix partitioning: all sequences are one bucket; a bucket of over LOCAL sequences is dealt by the turn behind its
   longest common prefix, round by round, and gives the nodes of that prefix. A round goes over the large buckets alone.
4. A bucket that has become local is finished in one task by multikey quicksort over the turns' numbers, which emits its nodes. What is summed
   over subtrees goes up through the rounds.
5. The digest of the conversations that end at a node is taken over chunks of sorted ids, cut by many tasks, so that a node at
   which a third of all conversations end is one stream of chunks.

A conversation is one sequence: its numbers (16 bytes a turn, not its texts) fit a task. There are as many rounds as forks lie one
behind the other in buckets of over LOCAL different sequences.

Cases. Rows without a conversation id belong to none. Turns without a number come first; turns of one number in the order of
their digests, repeated rows one after the other. A null role or text is an empty one. No rows give no nodes, not even the root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import crc_mod, empty_if_null, map_arrow, table, tasks_for

#: Different sequences of a bucket that one task finishes.
LOCAL = 512
#: Rows of one task of the shuffles, nodes of one batch, and bytes of a chunk of ids.
TASK_ROWS, BATCH_NODES, CHUNK = 1 << 18, 1 << 13, 1 << 20


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, ids and lens (the turns' numbers and code points, in order), and the dictionary: turn_id, digest."""
    spark = conversations.sparkSession
    role, text = empty_if_null("role"), empty_if_null("text")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turns = table(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("len")), "turns")
    parts = tasks_for(spark, turns.count(), TASK_ROWS)
    # numbers ascend with the digests
    numbered = turns.select("digest").distinct().repartitionByRange(parts, "digest").sortWithinPartitions("digest").select(F.monotonically_increasing_id().alias("turn_id"), "digest")
    dictionary = table(numbered, "turn-ids")
    in_order = F.sort_array(F.collect_list(F.struct("turn", "turn_id", "len")))
    found = turns.join(dictionary, "digest").groupBy("conv_id").agg(in_order.alias("s"))
    return found.select("conv_id", F.col("s.turn_id").alias("ids"), F.col("s.len").alias("lens")), dictionary


def rebuilt(found: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every; h is crc32(c) modulo heads."""
    found = table(found, "sequences")
    none = F.array().cast("array<long>")
    base = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "lens")])
    joined = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", crc_mod("conv_id", heads).cast("int")).join(base, "base", "left")
    own = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    return joined.select("conv_id", *[F.concat(F.slice(F.coalesce(f"head_{c}", none), F.lit(1), F.col("h")), own(c)).alias(c) for c in ("ids", "lens")])


class Subtree:
    """Nodes of one bucket, parents before children: the first is the bucket's own node."""

    def __init__(self, items: list[tuple], depth: int):
        self.parent, self.depth, self.n, self.conv, self.turn, self.saved, self.end, self.end_n = ([] for _ in range(8))
        self._sorted(items, depth)
        size = len(self.n)
        self.children, self.leaves = [0] * size, [0] * size
        for k in range(size - 1, -1, -1):
            if not self.children[k]:
                self.leaves[k] = 1
            if (up := self.parent[k]) is not None:
                self.children[up] += 1
                self.leaves[up] += self.leaves[k]
                self.saved[up] += self.saved[k]

    def _node(self, items: list[tuple], depth: int, parent: int | None) -> int:
        n = sum(x[2] for x in items)
        ids, lens = items[0][:2]
        self.parent.append(parent)
        self.depth.append(depth)
        self.n.append(n)
        self.conv.append(min(x[3] for x in items))
        self.turn.append(ids[depth - 1] if depth else None)
        self.saved.append((n - 1) * lens[depth - 1] if depth else 0)
        self.end.append(None)
        self.end_n.append(0)
        return len(self.n) - 1

    def _sorted(self, items: list[tuple], depth: int) -> None:
        """Multikey quicksort: sequences of a node are parted by their turn there into less, equal and greater; the equal ones are a child."""
        todo = [(items, depth, self._node(items, depth, None), True)]
        while todo:
            items, depth, node, fresh = todo.pop()
            if fresh:
                ended = [x for x in items if len(x[0]) == depth]
                for x in ended:  # sequences differ, so that one ends here at most
                    self.end[node], self.end_n[node] = x[3], x[2]
                items = [x for x in items if len(x[0]) > depth] if ended else items
            if not items:
                continue
            pivot = items[len(items) // 2][0][depth]
            less, equal, greater = [], [], []
            for x in items:
                (equal if x[0][depth] == pivot else less if x[0][depth] < pivot else greater).append(x)
            todo.append((greater, depth, node, False))
            todo.append((equal, depth + 1, self._node(equal, depth + 1, node), True))
            todo.append((less, depth, node, False))


_NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn_id long, end long, end_n long, bucket array<long>"
_TYPES = dict(zip((c.split()[0] for c in _NODES.split(", ")), [pa.int64(), pa.int32(), *[pa.int64()] * 8, pa.list_(pa.int64())]))


def _finished(buckets: DataFrame) -> DataFrame:
    """Nodes of local buckets, whose sequences come one behind the other; bucket is set in the row of a bucket's own node."""

    def run(batches):
        out = {c: [] for c in _TYPES}

        def finish(path, above, depth, items):
            t = Subtree(items, depth)
            up = [above if p is None else t.conv[p] for p in t.parent]
            for c, values in zip(_TYPES, (t.conv, t.depth, up, t.n, t.children, t.leaves, t.saved, t.turn, t.end, t.end_n, [path] + [None] * (len(t.n) - 1))):
                out[c].extend(values)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _TYPES.items()], names=list(_TYPES))
            for c in out:
                out[c].clear()
            return batch

        key, items = None, []
        for batch in batches:
            for path, depth, above, ids, lens, n, conv in zip(*[batch.column(c).to_pylist() for c in ("path", "depth", "above", "ids", "lens", "n", "conv")]):
                if path != (key and key[0]):
                    if key:
                        finish(*key, items)
                    key, items = (path, above, depth), []
                    if len(out["depth"]) >= BATCH_NODES:
                        yield flush()
                items.append((ids, lens, n, conv))
        if key:
            finish(*key, items)
            yield flush()

    return map_arrow(buckets, run, _NODES)


def _large(active: DataFrame) -> DataFrame:
    """Buckets of over LOCAL sequences: fork is the length of their longest common prefix, lens the code points up to there."""
    both = F.struct("ids", "lens")
    found = active.groupBy("path", "depth", "above").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(both).alias("lo"), F.max("ids").alias("hi"))
    found = found.where(F.col("sequences") > LOCAL)
    least = F.least(F.size("lo.ids"), F.size("hi"))
    # the first place where the least and the greatest sequence differ
    fork = F.coalesce(F.array_position(F.zip_with(F.slice("lo.ids", F.lit(1), least), F.slice("hi", F.lit(1), least), lambda a, b: a != b), True), F.lit(0))
    fork = F.when(fork > 0, fork - 1).otherwise(least).cast("int")
    return found.withColumn("fork", fork).select("path", "depth", "above", "n", "conv", "fork", F.slice("lo.ids", F.lit(1), F.col("fork")).alias("ids"), F.slice("lo.lens", F.lit(1), F.col("fork")).alias("lens"))


_PARENT = "slice(path, 1, size(path) - 1)"


def _spine(rounds: list[tuple[DataFrame, DataFrame]], finished: DataFrame) -> DataFrame:
    """Nodes of the large buckets' common prefixes, from the last round up: large buckets and their sequences that end at the fork."""
    roots = finished.where("bucket is not null").select(F.col("bucket").alias("path"), "n_leaves", "saved_tokens")
    below, nodes = None, None
    for number in range(len(rounds) - 1, -1, -1):
        large, ended = rounds[number]
        children = roots.where(F.size("path") == number + 1)
        children = children.unionByName(below) if below is not None else children
        sums = children.groupBy(F.expr(_PARENT).alias("path")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        full = large.join(sums, "path").join(ended, "path", "left")
        # own savings of the chain's nodes, from each depth on
        from_depth = lambda k: (F.col("n") - 1) * F.aggregate(F.slice("lens", F.greatest(k, F.lit(1)), F.col("fork") - F.greatest(k, F.lit(1)) + 1), F.lit(0).cast("long"), lambda s, x: s + x)
        k = F.col("k")
        chain = full.withColumn("k", F.explode(F.sequence("depth", "fork")))
        last = k == F.col("fork")
        chain = table(
            chain.select(
                "path", F.col("conv").alias("conv_id"), k.alias("depth"), F.when(k == F.col("depth"), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
                (F.col("below") + from_depth(k)).alias("saved_tokens"), F.when(k > 0, F.try_element_at("ids", k)).alias("turn_id"), F.when(last, F.col("end")).alias("end"), F.when(last, F.coalesce("end_n", F.lit(0))).otherwise(0).cast("long").alias("end_n"), (k == F.col("depth")).alias("top"),
            ),
            "trie-spine",
        )
        below = chain.where("top").select("path", "n_leaves", "saved_tokens")
        nodes = chain.drop("path", "top") if nodes is None else nodes.unionByName(chain.drop("path", "top"))
    return nodes


def _chunks(members: DataFrame, parts: int) -> DataFrame:
    """key, first, ids: ascending ids of each key, joined by commas, in chunks whose limits are those of tasks and of CHUNK bytes."""

    def run(batches):
        key, first, ids, size = None, None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size >= CHUNK):
                    yield flush()
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield flush()

    return map_arrow(members.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"), run, "key long, first long, ids string")


def _digests(chunks: DataFrame, parts: int) -> DataFrame:
    """key, ends_sha256: over the chunks of each key in order, one at a time."""

    def run(batches):
        key, digest = None, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
                if digest is None or k != key:
                    if digest is not None:
                        yield flush()
                    key, digest = k, sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if digest is not None:
            yield flush()

    return map_arrow(chunks.repartition(parts, "key").sortWithinPartitions("key", "first"), run, "key long, ends_sha256 string")


def nodes(found: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, turn_id (of the last turn), ends_sha256.

    found: conv_id, ids, lens; each conversation once.
    """
    spark = found.sparkSession
    # a sequence's digest names it among the conversations; sequences are grouped by themselves
    found = table(found.withColumn("name", F.substring(F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)), 1, 16)), "sequences")
    different = found.groupBy("name", "ids", "lens").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    different = table(different, "different")
    parts = tasks_for(spark, different.count(), TASK_ROWS // 8)
    active = different.select(F.slice("ids", F.lit(1), F.lit(0)).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"), "ids", "lens", "n", "conv")
    rounds, local = [], None
    while True:
        large = table(_large(active), "trie-large")
        small = active.join(large.select("path"), "path", "left_anti")
        local = small if local is None else local.unionByName(small)
        if large.isEmpty():
            break
        dealt = active.drop("depth", "above").join(large.select("path", "fork", F.col("conv").alias("above")), "path")
        ended = dealt.where(F.size("ids") == F.col("fork")).select("path", F.col("conv").alias("end"), F.col("n").alias("end_n"))
        onward = dealt.where(F.size("ids") > F.col("fork")).withColumn("path", F.concat("path", F.slice("ids", F.col("fork") + 1, F.lit(1))))
        rounds.append((large, ended))
        active = table(onward.select("path", (F.col("fork") + 1).alias("depth"), "above", "ids", "lens", "n", "conv"), "trie-round")
    finished = table(_finished(local.repartition(parts, "path").sortWithinPartitions("path")), "trie-local")
    everything = finished.drop("bucket")
    if rounds:
        everything = everything.unionByName(_spine(rounds, finished))
    several = different.where("n > 1").select("name", F.col("conv").alias("key"))
    parts = tasks_for(spark, found.count(), TASK_ROWS)
    digests = _digests(_chunks(found.select("name", "conv_id").join(several, "name").select("key", "conv_id"), parts), parts)
    many = everything.where("end_n > 1").join(digests.withColumnRenamed("key", "end"), "end")
    few = everything.where("end_n <= 1").withColumn("ends_sha256", F.sha2(F.when(F.col("end_n") == 1, F.col("end").cast("string")).otherwise("").cast("binary"), 256))
    return few.unionByName(many).drop("end", "end_n")
