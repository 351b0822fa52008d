"""Near copies by the Jaccard similarity of word-shingle sets, found by filters under several global token orders.

A token is the 64-bit hash of a shingle. Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 tokens of
each, whatever global order the tokens stand in. The first order puts tokens that many sets share last, so its prefixes meet
seldom; two more are unrelated permutations, kept as bitmaps of the prefixes (sets that share a prefix token share a bit). A pair
must meet under all of them, fit in size, and have few differing parity bits (each token that only one set has flips one), all of
it where pairs are formed. What is left is verified on whole sets.

Sets that are equal are one class from the start. Of the classes that share a prefix token, the few most typical ones are compared
with all others; such pairs are told apart before bitmaps or sets travel. Who is in one component by then needs no more comparing.
Groups of the same classes count as one, and a pair is formed in the first group that it has in common, not in each.
Rounds of that go on in the groups with several components while each halves the pairs left and these are many, then all pairs left between
different components are compared. So thousands of copies cost thousands of comparisons, and no link is lost.

Only the sets of classes in such pairs travel. A table of bits of fixed size, set for their documents, tells each task which texts to make sets of;
the few others that fall on the same bits meet no pair.

The order's frequencies are counts over all documents in a table of hashed tokens of fixed size; they steer work, not results. A class is known by 60
bits of its set's hash. Defined results: null, empty and wordless texts have an empty set and are components of their own; rows
with equal ids and texts are one document; rows without id get no component; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.components import components, merged
from gavelspark.llm.shared import written
from gavelspark.llm.words import SHINGLE, find_words, mix, pieces, sequence_hashes

PERCENT = 80
BUCKETS = 1 << 25  # of the frequency table, of half a byte each
RANGES = 64  # parts in which it is summed
FLUSH_TOKENS = 1 << 22  # tokens that a task holds while it counts
LEADERS = 4  # classes of a group that are compared with all others in a round
MAX_ROUNDS = 3
CROSS = 16  # pairs of different components for each row of the groups, up to which they are compared at once
FEW = 1 << 24  # pairs of different components that cost less than another round
SLOTS = 1 << 27  # bits of the table of documents whose sets are made
NODE_BITS = 60
LISTED = 256  # groups of a class up to which its rows carry them all
_MAP_BITS = 128
_PARITY_BITS = 512
_SEEDS = [np.uint64(0x51ED270B1), np.uint64(0xA24BAED4963)]


class Sets:
    """Distinct tokens of each row of a text column, sorted within the row; `cuts` has where each row begins."""

    def __init__(self, column: pa.Array):
        words = find_words(column, lower=True)
        first, tokens = words.shingles()
        rows, n_words = words.rows[first], words.counts()
        short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
        if len(short):
            begin = np.searchsorted(words.rows, short)
            whole = np.empty(len(short), np.uint64)
            for width in range(1, SHINGLE):
                these = n_words[short] == width
                whole[these] = sequence_hashes(words.hashes, begin[these], width)
            rows, tokens = np.concatenate([rows, short]), np.concatenate([tokens, whole])
        order = np.lexsort((tokens, rows))
        rows, tokens = rows[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (np.diff(tokens) != 0) | (np.diff(rows) != 0)
        self.rows, self.tokens = rows[new], tokens[new]
        self.cuts = np.searchsorted(self.rows, np.arange(words.n_rows + 1))
        self.sizes = np.diff(self.cuts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.tokens + np.uint64(0x2545F4914F6CDD1D)))])
        self.nodes = (mix(sums[self.cuts[1:]] - sums[self.cuts[:-1]] + self.sizes.astype(np.uint64)) >> np.uint64(64 - NODE_BITS)).astype(np.int64)

    def prefix(self, percent: int, *keys: np.ndarray) -> np.ndarray:
        """Indexes of the tokens in each row's prefix, when rows are ordered by the keys, the last one first."""
        order = np.lexsort((*keys, self.rows))
        place = np.arange(len(order)) - self.cuts[self.rows]
        length = self.sizes - (self.sizes * percent + 99) // 100 + 1
        return order[place < length[self.rows]]

    def bitmaps(self, percent: int) -> list[np.ndarray]:
        """For each further order, the prefix tokens of each row as bits of two numbers."""
        maps = []
        for seed in _SEEDS:
            place = mix(self.tokens ^ seed)
            at = self.prefix(percent, place)
            bit = (mix(place[at]) % np.uint64(_MAP_BITS)).astype(np.int64)
            found = np.zeros((len(self.sizes), _MAP_BITS), np.uint8)
            found[self.rows[at], bit] = 1
            maps += list(np.packbits(found, axis=1).view(np.int64).T)
        return maps

    def parities(self) -> list[np.ndarray]:
        """Bits that tell for each row whether an odd number of its tokens falls on them, in numbers of 64."""
        bit = (mix(self.tokens ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(_PARITY_BITS)).astype(np.int64)
        odd = np.bincount(self.rows * _PARITY_BITS + bit, minlength=len(self.sizes) * _PARITY_BITS) & 1
        return list(np.packbits(odd.astype(np.uint8).reshape(-1, _PARITY_BITS), axis=1).view(np.int64).T)


_MAPS = [f"map{k}" for k in range(2 * len(_SEEDS))]
_PARITIES = [f"odd{k}" for k in range(_PARITY_BITS // 64)]
_TRAITS = ["n", *_MAPS, *_PARITIES]


def _profiles(docs: DataFrame, percent: int) -> DataFrame:
    """A row for each document (its class, set size and bitmaps), and rows of counts for the frequency table."""
    schema = f"doc_id long, node long, {', '.join(f'{t} long' for t in _TRAITS)}, range int, counts binary"
    names = ["doc_id", "node", *_TRAITS, "range", "counts"]
    types = [pa.int64()] * (2 + len(_TRAITS)) + [pa.int32(), pa.binary()]

    def rows(length: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(length, t) for c, t in zip(names, types, strict=True)], names)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, counts = np.unique((np.concatenate(held) % np.uint64(BUCKETS)).astype(np.uint32), return_counts=True)
        cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * (BUCKETS // RANGES))
        packed = [_pack(bucket[lo:hi] - np.uint32(r * (BUCKETS // RANGES)), counts[lo:hi]) for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return rows(RANGES, range=np.arange(RANGES), counts=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for piece in pieces(batch):
                sets = Sets(piece.column("text"))
                traits = dict(zip(_TRAITS, [sets.sizes, *sets.bitmaps(percent), *sets.parities()], strict=True))
                yield rows(len(piece), doc_id=piece.column("doc_id"), node=sets.nodes, **traits)
                held.append(sets.tokens[_unseen(sets, seen)[sets.rows]])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield counted(held)
                    held, size, seen = [], 0, set()
        if held:
            yield counted(held)

    return docs.mapInArrow(run, schema)


def _unseen(sets: Sets, seen: set[int]) -> np.ndarray:
    """Which rows are the first ones of their class; adds the classes to those seen."""
    new = np.zeros(len(sets.nodes), bool)
    for k, node in enumerate(sets.nodes.tolist()):
        new[k] = node not in seen
        seen.add(node)
    return new


def _pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts, in three planes of bytes that compress well. A gap too wide for two bytes is bridged by counts of 0."""
    wide = np.diff(at, prepend=np.uint32(0)) >> np.uint32(16)
    if wide.any():
        at, counts = np.repeat(at, wide + 1), np.repeat(counts, wide + 1)
        ends = np.cumsum(wide + 1) - 1
        steps = np.diff(at[ends], prepend=np.uint32(0)) & np.uint32(0xFFFF)
        bridge = np.ones(len(at), bool)
        bridge[ends] = False
        gaps = np.full(len(at), 0xFFFF, np.uint32)
        gaps[ends] = steps + wide.astype(np.uint32)  # each bridge is one short of 2 ** 16
        counts = np.where(bridge, 0, counts)
        return _pack(np.cumsum(gaps, dtype=np.uint32), counts) if (gaps >> np.uint32(16)).any() else _planes(gaps, counts)
    return _planes(np.diff(at, prepend=np.uint32(0)), counts)


def _planes(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    pairs = gaps.astype("<u2").view(np.uint8).reshape(-1, 2)
    return pairs[:, 0].tobytes() + pairs[:, 1].tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, counts = np.frombuffer(data, np.uint8).reshape(3, -1)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8)), counts


class Frequencies:
    """Logarithm of how often the tokens of a bucket occur, two buckets to a byte, and its median over all buckets."""

    def __init__(self, halves: np.ndarray):
        self.halves = halves
        sample = halves[::997]
        self.usual = int(np.median(np.concatenate([sample & 15, sample >> 4])))

    @classmethod
    def of(cls, profiles: DataFrame) -> Frequencies:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for number, data in zip(batch.column("range").to_pylist(), batch.column("counts"), strict=True):
                    at, counts = _unpack(data.as_py())
                    np.add.at(sums.setdefault(number, np.zeros(BUCKETS // RANGES, np.int64)), at, counts)
            for number, total in sums.items():
                log = np.minimum(np.log2(total + 1), 15).astype(np.uint8).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([(log[:, 0] | (log[:, 1] << 4)).tobytes()])], ["range", "halves"])

        blocks = profiles.where("range is not null").select("range", "counts").repartition(RANGES, "range")
        found = blocks.mapInArrow(run, "range int, halves binary").toArrow()
        size = BUCKETS // RANGES // 2
        halves = np.zeros(BUCKETS // 2, np.uint8)
        for number, data in zip(found.column("range").to_pylist(), found.column("halves"), strict=True):
            halves[number * size:(number + 1) * size] = np.frombuffer(data.as_py(), np.uint8)
        return cls(halves)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        bucket = (tokens % np.uint64(BUCKETS)).astype(np.int64)
        return (self.halves[bucket >> 1] >> ((bucket & 1) << 2).astype(np.uint8)) & 15


def _postings(docs: DataFrame, frequencies: Frequencies, percent: int) -> DataFrame:
    """(token, node) for the prefix of each set under the first order. Smaller nodes are more typical: fewer of their tokens are rare.

    Copies that a task meets soon after each other are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for piece in pieces(batch):
                sets = Sets(piece.column("text"))
                often = shared.value(sets.tokens)
                rare = np.bincount(sets.rows, often <= shared.value.usual + 1, len(sets.sizes))
                nodes = sets.nodes | ((7 * rare / np.maximum(sets.sizes, 1)).astype(np.int64) << NODE_BITS)
                at = sets.prefix(percent, mix(sets.tokens), often)
                at = at[_unseen(sets, seen)[sets.rows[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(sets.tokens[at].view(np.int64)), pa.array(nodes[sets.rows[at]])], ["token", "node"])

    return docs.mapInArrow(run, "token long, node long")


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)) + 1


def _bits(pairs: DataFrame, profile: DataFrame) -> np.ndarray:
    """The table of bits, set for one document of each class in the pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    slots = profile.select("node", "doc_id").join(nodes, "node", "left_semi").select(_slot().alias("slot"))
    parts = slots.select("slot", F.bitmap_bucket_number("slot").alias("part")).repartition("part")
    found = parts.groupBy("part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for part, data in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
        of_part = np.frombuffer(data.as_py(), np.uint8)
        bits[(part - 1) * len(of_part):part * len(of_part)] = of_part
    return bits


def _token_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, tokens) of the classes whose documents have their bit set, and of few others; each once."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy() - 1
            batch = batch.filter(pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            seen = set()
            for piece in pieces(batch) if len(batch) else ():
                sets = Sets(piece.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(sets.cuts, pa.int32()), pa.array(sets.tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sets.nodes), lists], ["node", "tokens"]).filter(pa.array(_unseen(sets, seen)))

    return docs.select("text", _slot().alias("slot")).mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def _bare(node: str) -> Column:
    return F.col(node).bitwiseAND(F.lit((1 << NODE_BITS) - 1))


def _may_link(percent: int) -> Column:
    """Whether sides a and b pass the filters: size, prefixes under the further orders, differing parities."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    fits = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    for k in range(0, len(_MAPS), 2):
        meet = [a(m).bitwiseAND(b(m)) != 0 for m in _MAPS[k:k + 2]]
        fits &= meet[0] | meet[1]
    differing = sum((F.bit_count(a(p).bitwiseXOR(b(p))) for p in _PARITIES), F.lit(0))
    return fits & ((100 + percent) * differing <= (100 - percent) * (a("n") + b("n")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(f"bare_{side}"), F.col("tokens").alias(f"of_{side}")) for side in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    # The many partners of one leader lie apart by b; the join on a can be split where one leader has most pairs.
    return (
        pairs.select("a", "b", _bare("a").alias("bare_a"), _bare("b").alias("bare_b")).join(b, "bare_b").join(a, "bare_a")
        .select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
        .where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b"))


def _links(docs: DataFrame, pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, written; of the documents, only sets of the pairs' classes travel."""
    pairs = written(pairs)
    sets = written(_token_sets(docs, _bits(pairs, profile)))
    return written(_verified(pairs, sets, percent))


def _members(postings: DataFrame) -> DataFrame:
    """(token, node, place, leaders) of the groups, which are the classes with a token in common, two at least.

    A class's place is its rank in the group, the most typical one first; places beyond LEADERS are not told apart. One shuffle of the postings does it all.
    """
    group = Window.partitionBy("token").orderBy("node")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = postings.withColumn("before", F.lag("node").over(group)).where("before is null or before != node")
    leaders = F.array(*(F.nth_value("node", k + 1).over(whole) for k in range(LEADERS)))
    placed = each.select("token", "node", F.least(F.row_number().over(group), F.lit(LEADERS + 1)).alias("place"), leaders.alias("leaders"))
    return placed.where(F.col("leaders")[1].isNotNull())


def _merged(groups: DataFrame) -> DataFrame:
    """Groups of the same classes as one group, as each would give the same pairs. Its token is a hash of the classes."""
    same = F.bit_xor(F.xxhash64("node")).over(Window.partitionBy("token"))
    return groups.withColumn("token", same).dropDuplicates(["token", "node"])


def _led(members: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, of the leaders of each group and its other classes. Traits meet each pair once, however many tokens it has in common."""
    pairs = members.select(F.explode("leaders").alias("a"), F.col("node").alias("b")).where("a < b").distinct()
    return (
        pairs.alias("p").join(traits.alias("a"), F.col("p.a") == F.col("a.node"))
        .join(traits.alias("b"), (F.col("p.b") == F.col("b.node")) & _may_link(percent)).select("p.a", "p.b"))


def _labelled(groups: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, float]:
    """Groups without their leaders, with more than one component left and new places; their rows, and the pairs of different components."""
    rest = groups.where(F.col("place") > LEADERS).select("token", "node").join(labels, "node", "left")
    rest = rest.select("token", "node", F.coalesce("label", "node").alias("label"))
    group = Window.partitionBy("token")
    others = F.count("*").over(group) - F.count("*").over(Window.partitionBy("token", "label"))
    place = F.least(F.row_number().over(group.orderBy("node")), F.lit(LEADERS + 1))
    mixed = rest.withColumn("others", others).withColumn("place", place).where("others > 0")
    rows = written(_merged(mixed))
    total = rows.agg(F.sum("others").alias("cross"), F.count("*").alias("rows")).first()
    return rows.drop("others"), total.rows, float(total.cross or 0) / 2


def _met(groups: DataFrame, traits: DataFrame, percent: int, leaders: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a group and may link; with `leaders`, a is one of the group's.

    A pair is formed in the first of its common groups only. A class of more than LISTED groups does without: its pairs come from each of them.
    """
    def side(rows: DataFrame) -> DataFrame:
        of_node = rows.groupBy("node").agg(F.collect_list("token").alias("tokens"))
        listed = of_node.withColumn("tokens", F.when(F.size("tokens") <= LISTED, F.col("tokens")))
        return rows.join(traits.join(listed, "node"), "node")

    a, b = side(groups.where(F.col("place") <= LEADERS) if leaders else groups).alias("a"), side(groups).alias("b")
    first = F.array_min(F.array_intersect("a.tokens", "b.tokens")) == F.col("a.token")
    may = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _may_link(percent)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & may & F.coalesce(first, F.lit(True)))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _labels(docs: DataFrame, members: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """(node, label) of every class with a link. Members are those of the groups; the profile has doc_id and traits by node."""
    traits = profile.drop("doc_id")
    labels = components(_links(docs, _led(members, traits, percent), profile, percent))
    groups, before = members.drop("leaders"), float("inf")
    for turn in range(MAX_ROUNDS + 1):
        groups, rows, cross = _labelled(groups, labels)
        if not rows:
            break
        last = turn == MAX_ROUNDS or cross <= max(CROSS * rows, FEW) or 2 * cross > before
        before = cross
        new = _links(docs, _met(groups, traits, percent, leaders=not last), profile, percent)
        if not new.isEmpty():
            labels = merged(labels, new)
        if last:
            break
    return labels


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = written(_profiles(docs, percent))
    each = profiles.where("range is null")
    found = each.where("n > 0 and doc_id is not null")
    classes = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.max(t).alias(t) for t in _TRAITS))

    postings = _postings(docs.where("doc_id is not null"), Frequencies.of(profiles), percent)
    members = written(_merged(_members(postings)))
    of_member = members.select("node").distinct().withColumn("bare", _bare("node")).join(classes.withColumnRenamed("node", "bare"), "bare").drop("bare")
    profile = written(of_member)
    labels = _labels(docs, members, profile, percent)

    linked = labels.join(profile.select("node", "doc_id"), "node")
    smallest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(smallest, "label").select(_bare("node").alias("node"), "component_id")
    of_class = classes.select("node", "doc_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    with_class = found.select("doc_id", "n", "node").join(of_class, "node")
    alone = each.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_class.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns. Rows without id stay."""
    kept = written(near_copies(docs, percent).where("doc_id = component_id").select("doc_id").distinct())
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text", *[c for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith("map")])
    one = (
        docs.join(kept, "doc_id", "left_semi").withColumn("__copy", F.row_number().over(first)).where(F.col("__copy") == 1).drop("__copy"))
    return one.union(docs.where("doc_id is null"))
