"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks, in DataFrame operations only.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the sum of all sizes (words). A target stops at
three times its source's size; the excess is shared anew by weight. Both follow from one pass over the sources in the order in
which they reach their limits.

Blocks. A hash of doc_id deals each source into blocks, so a hot source is spread as evenly as any. The quota of a source is its
target in blocks: all blocks once for each whole time that its size fits, then blocks in permuted order, and of the last one the
documents, in hash order, that fit into the rest; later passes fill what large ones left open.

Shards. The quotas go down a binary tree. At each node the left half of the blocks is a draw without replacement, so the number of each source's
blocks in it follows the multivariate hypergeometric distribution, drawn source by source from what is left. A leaf holds
exact counts for each source; the permuted blocks are dealt out by them, no block twice. Within a shard rows are shuffled by a hash.

Everything random comes from hashes, so reruns agree. Only the table of sources (a row for each) is ordered in one task.
Defined results: null texts have size 0; null sources are a source of their own; rows with equal ids share a block, and each row
counts; empty tables give empty results. Other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.shared import word_count, written

# Fixed values.
WEIGHTS = (5, 2, 1)
LIMIT = 3

BLOCK_DOCS = 256  # documents in a block, about
MAX_BLOCKS = 65_536  # blocks of a source, at most; they grow beyond
SHARD_WORDS = 8_000_000
PASSES = 3  # over the documents of a last block
_TAILS = 12  # standard deviations of a draw that are looked at


def hashed(*parts: Column) -> Column:
    """60 bits of the parts' digest: the same number in any engine that knows MD5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ln_factorial(x: Column) -> Column:
    """Stirling's series, at an argument raised by 7."""
    z, product = x + 8.0, x + 1.0
    for k in range(2, 8):
        product = product * (x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`: the quantile of u."""
    ln = lambda a, b: ln_factorial(a) - ln_factorial(b) - ln_factorial(a - b)
    share = F.when(total > 0, marked / total).otherwise(0.0)
    mean = drawn * share
    wide = _TAILS * F.sqrt(mean * (1 - share) * F.when(total > 1, (total - drawn) / (total - 1)).otherwise(0.0)) + 2
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - wide))
    high = F.least(drawn, marked, F.ceil(mean + wide))
    ways = ln(total, drawn)

    def step(state: Column, k: Column) -> Column:
        p = F.exp(ln(marked, k) + ln(total - marked, drawn - k) - ways)
        return F.when(state["below"] < u, F.struct((state["below"] + p).alias("below"), k.alias("k"))).otherwise(state)

    return F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("below"), low.alias("k")), step)["k"]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: size, documents, weight, target, and how the target is made up of its blocks."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        found.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
        .withColumn("limit", LIMIT * F.col("source_size")).withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("size_left", F.col("all_size") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("limit") * F.col("weight_left") <= F.col("size_left") * F.col("weight")))
    shared = ranked.withColumns({
        "rest": F.col("all_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0)),
        "rest_weight": F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0))})
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        (F.col("rest") * F.col("weight")).cast("double") / F.when(F.col("rest_weight") > 0, F.col("rest_weight")).cast("double"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS))).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        shared.withColumn("target", target).withColumn("blocks", blocks).withColumn("rounds", rounds)
        .withColumn("left_over", F.col("target") - F.col("rounds") * F.col("source_size"))
        .select("source", "rank", "source_size", "all_size", "target", "blocks", "rounds", "left_over"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, bounds): the permuted blocks of a source from bounds[j - 1] on, up to bounds[j], belong to shard j."""
    nodes = quotas.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("counts"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), "counts")
    ranks = quotas.groupBy().agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    for level in range(int(math.log2(shards))):
        at = F.concat_ws("/", F.lit(seed), F.lit(level), F.col("node"))

        def draw(state: Column, x: Column) -> Column:
            u = (hashed(at, x["i"]) + 0.5) / float(1 << 60)  # noqa: B023
            k = hypergeometric(state["total"], x["n"], state["drawn"], u)
            return F.struct(
                F.concat(state["left"], F.array(k)).alias("left"), (state["total"] - x["n"]).alias("total"), (state["drawn"] - k).alias("drawn"))

        begin = F.struct(F.array().cast("array<long>").alias("left"), total.alias("total"), F.floor(total / 2).alias("drawn"))
        left = F.aggregate(F.transform("counts", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), begin, draw)["left"]
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("counts")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")))
        nodes = written(nodes.withColumn("left", left).select(F.inline(halves)))
    one = nodes.select("node", F.posexplode("counts").alias("i", "n")).join(
        ranks.select(F.posexplode("ranks").alias("i", "rank")), "i")
    up_to = F.sum("n").over(Window.partitionBy("rank").orderBy("node"))
    return one.withColumn("upto", up_to).groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "upto"))), lambda x: x["upto"]).alias("bounds"))


def plan(sizes: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sources, draws). Draws: for each source and block, the shards that take it, and where it is the last and partial one, what it may give."""
    sources = written(targets(sizes))
    keyed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("rank", "blocks", "rounds", "left_over", "doc_id", "size")
    blocks = keyed.groupBy("rank", F.pmod(hashed(F.lit(seed), F.col("doc_id")), F.col("blocks")).alias("block")).agg(
        F.sum("size").alias("words"), F.first("rounds").alias("rounds"), F.first("left_over").alias("left_over"))
    order = Window.partitionBy("rank").orderBy(hashed(F.lit(seed), F.lit("block"), F.col("rank"), F.col("block")), "block")
    placed = (
        blocks.withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.count("*").over(Window.partitionBy("rank"))).withColumn("room", F.col("left_over") - (F.col("upto") - F.col("words"))))
    extra = F.when((F.col("room") > 0) & (F.col("words") > 0), F.lit(1)).otherwise(F.lit(0))
    placed = written(placed.withColumn("times", F.col("rounds") + extra).withColumn(
        "room", F.when((extra == 1) & (F.col("upto") > F.col("left_over")), F.col("room"))))
    quotas = placed.groupBy("rank").agg(F.sum("times").alias("quota"))
    all_words = sources.agg(F.max("all_size")).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, all_words / SHARD_WORDS))))
    bounds = split_tree(quotas, shards, seed)
    number = lambda k: k * F.col("number") + F.col("place")
    shard = lambda k: F.size(F.filter("bounds", lambda b: b <= number(k)))
    draws = placed.join(bounds, "rank").select(
        "rank", "block", "room", F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(1), F.greatest("times", F.lit(1))), lambda k: shard(k - 1)))
        .otherwise(F.array().cast("array<int>")).alias("shards"))
    return sources, written(draws)


def drawn(rows: DataFrame, sources: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (with __doc, __source, __size) and the shards that take them, their source's size and target. Any other columns pass through."""
    src = sources.select(F.col("source").alias("__name"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("blocks").alias("__blocks"))
    rows = rows.join(src, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
    rows = rows.withColumn("__block", F.pmod(hashed(F.lit(seed), F.col("__doc")), F.col("__blocks"))).drop("__blocks")
    of_block = draws.select(F.col("rank").alias("__rank"), F.col("block").alias("__block"), F.col("room").alias("__room"), F.col("shards").alias("__shards"))
    rows = rows.join(of_block, ["__rank", "__block"])
    whole = rows.where("__room is null")
    place = Window.partitionBy("__rank").orderBy(hashed(F.lit(seed), F.lit("doc"), F.col("__doc")), "__doc", "__size")
    part = rows.where("__room is not null").withColumn("__got", F.lit(False))
    own = Window.partitionBy("__rank")
    for _ in range(PASSES):
        gap = F.col("__room") - F.sum(F.when(F.col("__got"), F.col("__size")).otherwise(F.lit(0))).over(own)
        part = part.withColumn("__gap", gap)
        fits = ~F.col("__got") & (F.col("__size") > 0) & (F.col("__size") <= F.col("__gap"))
        so_far = F.sum(F.when(fits, F.col("__size")).otherwise(F.lit(0))).over(place.rowsBetween(Window.unboundedPreceding, 0))
        part = part.withColumn("__got", F.col("__got") | (fits & (so_far <= F.col("__gap"))))
    part = part.withColumn("__shards", F.when(F.col("__got"), F.col("__shards")).otherwise(F.slice("__shards", F.lit(1), F.greatest(F.size("__shards") - 1, F.lit(0)))))
    return whole.union(part.drop("__got", "__gap")).drop("__rank", "__block", "__room")


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """What the mix takes of each document."""
    sizes = written(sized(docs))
    sources, draws = plan(sizes, seed)
    rows = sizes.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    return drawn(rows, sources, draws, seed).select(
        F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.size("__shards")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: documents as often as it takes them, with all their columns and their shard, shuffled within each shard."""
    sources, draws = plan(written(sized(docs)), seed)
    rows = docs.withColumns({
        "__doc": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": word_count(F.col("text").cast("string"))})
    copies = drawn(rows, sources, draws, seed).select(*docs.columns, F.posexplode("__shards").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(seed), "doc_id", "mix_copy", "mix_shard")
    return copies.withColumn("__order", order).repartition("mix_shard").sortWithinPartitions("mix_shard", "__order").drop("__order")
