"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

Each source's documents fall into BLOCKS hashed blocks. A source's quota is its target number of words: in each of two
passes over its blocks, in an order permuted by hash, whole blocks are taken until the target lies within one; of that
block the documents up to a hash limit are taken, and a few more documents of the source close the rest. The quota
in blocks is split among the output shards by a binary tree: each node deals all its sources' blocks by hash and hands the
lower half of them, exactly, to its left child, so that the sources' shares of that half are a multivariate hypergeometric
draw; the shards' quotas add up exactly. Then shards receive disjoint runs of the permuted blocks, and each shard is
ordered by hash.

All draws are hashes of seed and ids: reruns agree. What grows with the data is summed by (source, block) before it is
shuffled. Sources may be many: they are ranked by ranges, a node is a row for each of its sources, and its middle is found
by a histogram of the hashes and an order of the few blocks in one bin. To the driver go counts of ranges and bins.

Cases: a null text has size 0; a null source is a source of its own, the last; rows with equal ids share one fate; a
source without words has target 0; an empty table gives an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import table, tasks_for, without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2
BLOCKS = 1024
#: Share of a target, 3 times the source's largest document at most, that single documents fill.
RESERVE = 0.15
SHARDS = 8
#: Rows of a mix behind one partition.
RUN_ROWS = 1 << 17
SEED = 7
#: A node's blocks are counted by so many first bits of their hashes.
BIN_BITS = 12
#: Documents of a block are summed by their hashes without so many last bits.
INNER_BITS = 54
ADDED = ("size", "source_size", "target", "taken", "shards")


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranks(sources: DataFrame) -> DataFrame:
    """sources with rank, from 1 in code point order of source, null last. Sources are dealt into ranges; the driver sees the
    ranges' sizes alone."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(sources.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_place", place).join(offsets, "_range").withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with rank, target: the words that each gives.

    Weights repeat over the sources in code point order. A target stops at most x its source's size; what that leaves is
    dealt out again by weight until none is above. The loop hands three sums to the driver, no rows.
    """
    ranked = ranks(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = table(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)), "mix-sources")
    level, capped = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        total, closed, open_weight, n = ranked.agg(F.sum("source_size"), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if not total or not open_weight or n == capped:
            break
        level, capped = (total * share - (closed or 0.0)) / open_weight, n
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level))).drop("weight", "most")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rank, shard, n from quotas (rank, n): exact shares of the sources' quotas for each shard, for a power of two of shards.

    A node holds a row for each source. Each of its blocks has a hash; the half with the lowest hashes goes left. Blocks
    aren't shuffled: they are counted by hash bin, then those of the bins below the middle by source, and the few of the
    middle's bin are put in order.
    """
    spark = quotas.sparkSession
    nodes = quotas.select(F.lit(0).alias("node"), F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n")).where("n > 0")
    count = 1
    while count < shards:
        nodes = table(nodes, "mix-tree")
        blocks = nodes.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("hash", F.xxhash64(F.lit(seed), F.lit("tree"), F.lit(count), "node", "rank", "block"))
        blocks = blocks.withColumn("bin", F.shiftrightunsigned("hash", 64 - BIN_BITS))
        # at most 2 ** BIN_BITS counts for each of fewer nodes than shards
        middles = []
        histogram: dict[int, list[tuple[int, int]]] = {}
        for r in blocks.groupBy("node", "bin").count().collect():
            histogram.setdefault(r["node"], []).append((r["bin"], r["count"]))
        for node, bins in histogram.items():
            need = sum(n for _, n in bins) // 2
            for at, n in sorted(bins):
                if n > need:
                    middles.append((node, at, need))
                    break
                need -= n
        middle = F.broadcast(spark.createDataFrame(middles, "node int, middle long, need long"))
        placed = blocks.join(middle, "node")
        below = placed.where("bin < middle").groupBy("node", "rank").agg(F.count(F.lit(1)).alias("x"))
        order = F.row_number().over(Window.partitionBy("node").orderBy("hash", "rank", "block"))
        within = placed.where("bin = middle").withColumn("at", order).where("at <= need").groupBy("node", "rank").agg(F.count(F.lit(1)).alias("x"))
        drawn = below.unionByName(within).groupBy("node", "rank").agg(F.sum("x").alias("x"))
        each = nodes.join(drawn, ["node", "rank"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
        sides = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("x").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("x")).alias("n"))))
        nodes = each.select("rank", sides.alias("c")).select("c.node", "rank", "c.n").where("n > 0")
        count *= 2
    return table(nodes, "mix-leaves").select("rank", F.col("node").alias("shard"), "n")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target (the source's), taken (words) and shards: an output shard for each copy taken."""
    docs = without(docs, *ADDED)
    order = F.xxhash64(F.lit(seed), F.col(key))
    placed = docs.withColumns({"size": sizes(F.col(text)), "_key": order, "_block": F.pmod(order, F.lit(blocks)).cast("int")})
    light = table(placed.select(F.col(source).alias("source"), F.col("_block").alias("block"), F.col("_key").alias("key"), "size"), "mix-sizes")
    cells = light.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("size").alias("largest"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.max("largest").alias("largest")))
    sources = table(sources, "mix-targets")

    passes = F.explode(F.array(F.lit(1), F.lit(2)))
    wanted = sources.withColumn("pass", passes).withColumn("want", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - (F.col("pass") - 1) * F.col("source_size"))))
    # blocks fill all but a reserve, from which single documents close the rest
    reserve = F.when(F.col("want") < F.col("source_size"), F.least(F.col("want") * RESERVE, 3.0 * F.col("largest"))).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("by_block", F.col("want") - reserve).drop("largest")
    cells = cells.drop("largest")
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = cells.join(wanted, null_safe(cells, wanted)).drop(wanted["source"])
    permuted = F.xxhash64(F.lit(seed), F.lit("block"), F.col("rank"), F.col("pass"), F.col("block"))
    by_source = Window.partitionBy("rank", "pass").orderBy("permuted", "block")
    dealt = dealt.withColumn("permuted", permuted).withColumn("upto", F.sum("words").over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("words")
    state = F.when(F.col("upto") <= F.col("by_block"), "whole").when((before <= F.col("by_block")) & (F.col("want") > 0), "part")
    chosen = table(dealt.withColumn("state", state).withColumns({"rest": F.col("by_block") - before, "reserve": F.col("want") - F.col("by_block")}).where("state is not null").select("source", "rank", "pass", "block", "permuted", "state", "rest", "reserve"), "mix-blocks")

    # documents of the block in which the target lies: those up to a hash limit
    part = chosen.where("state = 'part'").select("source", "rank", "pass", "block", "rest", "reserve")
    inner_order = F.xxhash64(F.lit(seed), F.lit("document"), F.col("pass"), F.col("key"))
    inside = light.join(part, null_safe(light, part) & (light["block"] == part["block"])).drop(part["source"], part["block"]).withColumn("order", inner_order)
    # sums by the first bits of the order, then single documents where the target lies
    inside = inside.withColumn("bin", F.shiftright("order", INNER_BITS))
    of_pass = Window.partitionBy("rank", "pass")
    bins = inside.groupBy("rank", "pass", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("reserve").alias("reserve"))
    bins = bins.withColumn("before", F.sum("words").over(of_pass.orderBy("bin")) - F.col("words")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = inside.drop("rest", "reserve").join(bins.drop("words"), ["rank", "pass", "bin"])
    running = F.col("before") + F.sum("size").over(of_pass.orderBy("order"))
    fits = F.col("running") <= F.col("rest")
    limits = edge.withColumn("running", running).groupBy("rank", "pass").agg(F.max(F.when(fits, F.col("order"))).alias("limit"), F.max(F.when(fits, F.col("running"))).alias("filled"), *(F.max(c).alias(c) for c in ("before", "bin")), F.max(F.col("rest") + F.col("reserve")).alias("rest"))
    lower = F.when(F.col("bin") > -(1 << (63 - INNER_BITS)), F.shiftleft("bin", INNER_BITS) - 1)
    limits = table(limits.select("rank", "pass", F.coalesce("limit", lower).alias("limit"), (F.col("rest") - F.coalesce("filled", "before")).alias("left")), "mix-limits")

    # documents, of those not taken in the pass, that close the rest: of each size class (an eighth of a power of two) the largest and
    # the smallest are candidates; the largest that fits is taken until none does, then one that comes nearer, if any
    open_passes = limits.where("left > 0").join(sources.select("source", "rank"), "rank")
    rest = light.join(open_passes, null_safe(light, open_passes)).drop(open_passes["source"])
    state_of = chosen.select("rank", "pass", "block", "state")
    rest = rest.join(state_of, ["rank", "pass", "block"], "left").withColumn("order", inner_order)
    untaken = F.col("state").isNull() | ((F.col("state") == "part") & (F.col("limit").isNull() | (F.col("order") > F.col("limit"))))
    one = F.struct("size", "key")
    classes = rest.where(untaken & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left"))).groupBy("rank", "pass", F.floor(8 * F.log2("size")).alias("class")).agg(F.max(one).alias("most"), F.min(one).alias("least"), F.max("left").alias("left"))
    candidates = classes.groupBy("rank", "pass").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("most", "least")))), asc=False).alias("some"), F.max("left").alias("left"))

    def take(acc: Column, c: Column) -> Column:
        fits = c["size"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - c["size"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["keys"], c["key"])).otherwise(acc["keys"]).alias("keys"))

    greedy = F.aggregate("some", F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("keys")), take)
    nearer = lambda c: ~F.array_contains(F.col("g.keys"), c["key"]) & (F.abs(F.col("g.left") - c["size"]) < F.col("g.left"))
    last = F.array_min(F.transform(F.filter("some", nearer), lambda c: F.struct(F.abs(F.col("g.left") - c["size"]).alias("off"), c["key"].alias("key"))))["key"]
    closing = candidates.withColumn("g", greedy).select("rank", "pass", F.array_compact(F.array_append(F.col("g.keys"), last)).alias("closing"))

    # blocks in their permuted order meet the shards' quotas
    quotas = chosen.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    leaves = split_tree(quotas, shards, seed).withColumn("high", F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    leaves = leaves.where("n > 0").select("rank", "shard", (F.col("high") - F.col("n")).alias("low"), "high")
    numbered = chosen.withColumn("at", F.row_number().over(Window.partitionBy("rank").orderBy("pass", "permuted", "block")) - 1)
    token = numbered.join(leaves, "rank").where("at >= low and at < high").select("source", "rank", "pass", "block", "state", "shard")
    token = token.join(limits.select("rank", "pass", "limit"), ["rank", "pass"], "left")

    whole = lambda p, c: F.max(F.when(F.col("pass") == p, c))
    by_block = token.groupBy("rank", "block").agg(*[whole(p, F.col(c)).alias(f"{c}{p}") for p in (1, 2) for c in ("state", "shard", "limit")])
    extra = closing.groupBy("rank").agg(*[whole(p, F.col("closing")).alias(f"closing{p}") for p in (1, 2)])
    every = light.select("source", "block").distinct()
    facts = sources.join(extra, "rank", "left")
    grid = every.join(facts, null_safe(every, facts)).drop(facts["source"]).join(by_block, ["rank", "block"], "left")
    grid = table(grid.withColumnRenamed("source", "_source").withColumnRenamed("block", "_cell").drop("rank"), "mix-grid")

    joined = placed.join(grid, placed[source].eqNullSafe(grid["_source"]) & (placed["_block"] == grid["_cell"]))

    def copy(p: int) -> Column:
        ordered = F.xxhash64(F.lit(seed), F.lit("document"), F.lit(p), F.col("_key"))
        taken = (F.col(f"state{p}") == "whole") | ((F.col(f"state{p}") == "part") & (ordered <= F.col(f"limit{p}")))
        spare = F.pmod(F.xxhash64(F.lit(seed), F.lit("closing"), F.lit(p), F.col("_key")), F.lit(shards)).cast("int")
        return F.when(taken, F.col(f"shard{p}").cast("int")).when(F.array_contains(F.col(f"closing{p}"), F.col("_key")), spare)

    copies = F.array_compact(F.array(copy(1), copy(2)))
    out = joined.withColumn("shards", copies).withColumn("taken", (F.col("size") * F.size("shards")).cast("long"))
    return out.select(*docs.columns, *ADDED)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """A row for each copy taken, with shard and place; partitions hold runs of a shard's places in order.

    A shard is shuffled by hash: place is its order, whose runs, by its highest bits, may lie in different partitions. There are
    16 runs at least, and four for each partition, of which there are as many as the rows need.
    """
    taken = assign(docs, key, text, source, shards, blocks, seed).select(*without(docs, *ADDED, "shard", "place").columns, F.posexplode("shards").alias("_copy", "shard"))
    place = F.xxhash64(F.lit(seed), F.lit("place"), F.col(key), F.col("_copy"))
    placed = taken.withColumn("place", place).drop("_copy")
    n = tasks_for(docs.sparkSession, docs.count() * MOST_COPIES, RUN_ROWS)
    run = F.shiftright("place", 64 - max(4, (4 * n // shards).bit_length()))
    return placed.repartition(n, "shard", run).sortWithinPartitions("shard", "place")
