"""Minimax contiguous partition of documents into shards of near equal bytes.

Equal texts form an atomic group. Groups are ordered by a 64-bit hash of their text. Binary search, from the size of the
largest group up, finds the smallest capacity for which greedy filling, in that order, needs no more than the given shards;
no shard has more. Where one huge group of copies makes the capacity large, greedy cuts at it would fill some shards and leave
others empty. So a second search finds the smallest capacity of the shards that aren't one group larger than it, and cuts
are made at that: each at the group boundary nearest to an equal share of what remains, as long as the rest still fits.

The driver sees ranges of keys with their bytes instead of groups, 2 ** FIRST_BITS at first. A search over ranges tells
where its capacity, one byte less than that, and the cuts depend on the inside of a range; only these are split by
MORE_BITS further bits, and the search is done again, until none of them holds more than one group. The cuts are then
those of a search over every single group, whatever their number.

Slots number the rows of a shard without gaps: rows are counted by blocks of the checkpointed table, a running sum
over blocks gives each block's first slot. Only DataFrame operations run on the executors.

Null and empty texts form one group, with 0 text bytes and checksum 0. Repeated rows each get a slot. A null doc_id
stays null. Only doc_id and text are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import durable

#: Bits of the hash that the first ranges keep, and that each further round adds to a range that is split.
FIRST_BITS, MORE_BITS = 16, 8
#: Blocks times shards up to this number are broadcast, beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000
#: A block is 2 ** BLOCK_BITS rows of one partition of the checkpointed table.
BLOCK_BITS = 12
ROW_BYTES = 16


def greedy(sizes: list[int], capacity: int, sums: list[int] | None = None, at: int = 0, most: int | None = None) -> tuple[list[int], list[int]]:
    """(first group of each shard, the groups that did not fit) when shards are filled from group `at` on, to one beyond `most`."""
    sums = sums or [0, *accumulate(sizes)]
    starts, stops = [], []
    while at < len(sizes) and (most is None or len(starts) <= most):
        starts.append(at)
        to = bisect_right(sums, sums[at] + capacity) - 1
        at = max(at + 1, to)
        stops.append(to)
    return starts, stops


def cuts(sizes: list[int], shards: int, least: int | None = None) -> tuple[int, list[int], set[int]]:
    """(smallest feasible capacity, first group of each shard but the first, the groups whose atomicity this rests on).

    least: the size of the largest group, where sizes are those of ranges of groups; such a range may be larger than the capacity,
    and is then one of those that the result rests on."""
    sums = [0, *accumulate(sizes)]

    def smallest(low: int) -> int:
        high = max(low, sums[-1])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if len(greedy(sizes, mid, sums, 0, shards)[0]) <= shards else (mid + 1, high)
        return low

    capacity = smallest(max(sizes, default=0) if least is None else least)
    low = smallest(0)  # of the shards that aren't one huge group
    rests = {i for c in {capacity, low, max(0, low - 1)} for i in greedy(sizes, c, sums, 0, shards)[1]}

    def fit(at: int, into: int) -> tuple[bool, set[int]]:
        starts, stops = greedy(sizes, low, sums, at, into)
        return len(starts) <= into, set(stops)

    starts, at, left = [], 0, shards
    while at < len(sizes):
        starts.append(at)
        most = max(at + 1, bisect_right(sums, sums[at] + low) - 1)
        goal = sums[at] + (sums[-1] - sums[at]) / max(1, left)
        to = bisect_left(sums, goal)
        to = min(most, max(at + 1, to - 1 if to > at + 1 and goal - sums[to - 1] <= sums[min(to, len(sizes))] - goal else to))
        rests |= {to - 1, to}
        fits, stops = fit(to, left - 1)
        rests |= stops
        if to < most and not fits:
            little, enough = to, most
            while enough - little > 1:
                to = (little + enough) // 2
                little, enough = (little, to) if fit(to, left - 1)[0] else (to, enough)
            to = enough
            rests |= {to - 1, to} | fit(to, left - 1)[1] | fit(to - 1, left - 1)[1]
        at, left = to, left - 1
    return capacity, starts[1:], {i for i in rests if i < len(sizes)}


def ranges(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(first keys of ordered ranges, first range of each shard but the first) for groups of (key, size)."""

    def sums(some: DataFrame, bits: Column) -> list[tuple]:
        cell = F.expr("shiftright(key, 64 - bits)")
        return [tuple(r) for r in some.withColumn("bits", bits).groupBy("bits", cell.alias("cell")).agg(F.min("key"), F.max("key"), F.sum("size")).collect()]

    found = sorted((low, high, total, bits) for bits, _, low, high, total in sums(groups, F.lit(FIRST_BITS)))
    least = groups.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    while True:
        _, starts, rests = cuts([r[2] for r in found], shards, least)
        split = [found[i] for i in sorted(rests) if found[i][0] != found[i][1]]
        if not split:
            return [r[0] for r in found], starts
        names = groups.sparkSession.createDataFrame([(r[0] >> (64 - FIRST_BITS), *r[:2], min(64, r[3] + MORE_BITS)) for r in split], "first long, low long, high long, bits int")
        inside = groups.withColumn("first", F.shiftright("key", 64 - FIRST_BITS)).join(F.broadcast(names), "first").where("key between low and high")
        gone = set(split)
        found = sorted([r for r in found if r not in gone] + [(low, high, total, bits) for bits, _, low, high, total in sums(inside.drop("low", "high", "first"), F.col("bits"))])


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = durable(rows)
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("size")))
    firsts, starts = ranges(groups, shards)

    def number(key: Column) -> Column:
        return sum((F.when(key >= F.lit(firsts[i]), 1).otherwise(0) for i in starts), F.lit(0)).cast("int")

    block = F.shiftright("row", BLOCK_BITS)
    placed = rows.withColumn("shard", number(F.col("key"))).withColumn("block", block)
    counts = durable(placed.groupBy("shard", "block").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() <= MAX_BROADCAST_ROWS:
        base = F.broadcast(base)
    within = Window.partitionBy("block", "shard").orderBy("row")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(base, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
