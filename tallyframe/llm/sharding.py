"""Shards by minimax contiguous partition of ordered atomic groups (DataFrame operations only).

Documents with equal texts are one group and never split. Groups stand in the order of their text's md5.
The smallest capacity is searched for which a greedy pass over the order needs no more than the wanted
number of shards; the cuts of that pass are the shard borders. Groups above an even share of what is left
(a text with very many copies) get a shard of their own first, and the rest is partitioned among the others.

The search never sees all groups at once. Each round takes a bounded fence: the least and greatest prefix
sum of each of at most ``FENCE`` equal cells. A greedy pass that only uses known sums gives a feasible
capacity, one that may stop anywhere in a cell an infeasible one; between the two, the cuts can only lie in
small windows, and the next round refines those. When the windows hold few sums, the result is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.scale import range_rank
from .common import materialise, text_or_empty

FENCE = 65_536  # prefix sums the driver holds at once


def sized(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, key``: UTF-8 bytes plus ``overhead``, checksum and md5 of the text (null: empty)."""
    text = text_or_empty()
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def prefix_sums(groups: DataFrame) -> DataFrame:
    """Add ``upto``: sum of the sizes of all groups up to this one, in key order.

    The first 16 bits of the key cut the order into even cells; only a cell is ever sorted.
    """
    cell = F.conv(F.substring(F.hex("key"), 1, 4), 16, 10).cast("int")
    g = groups.withColumn("_cell", cell)
    cells = g.groupBy("_cell").agg(F.sum("bytes").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return (g.withColumn("_in", F.sum("bytes").over(inside)).join(cells, "_cell")
            .withColumn("upto", F.col("_before") + F.col("_in")).drop("_cell", "_in", "_before"))


class Fence:
    """Sorted prefix sums known to exist, and the gaps in which others may lie unseen."""

    def __init__(self, rows: list[tuple[int, int, int]], total: int):
        """rows: (least, greatest, count) of each cell."""
        rows = sorted(rows)
        self.known = sorted({0, total, *(x for r in rows for x in r[:2])})
        self.gaps = [(a, b) for a, b, n in rows if n > 2]
        self.gap_starts = [a for a, _ in self.gaps]

    def low(self, target: int) -> int:
        return self.known[bisect_right(self.known, target) - 1]

    def high(self, target: int) -> int:
        i = bisect_right(self.gap_starts, target) - 1
        return target if i >= 0 and target < self.gaps[i][1] else self.low(target)

    def cuts(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = (self.high if optimistic else self.low)(min(at + capacity, self.known[-1]))
            out.append(at)
        return out


def smallest(fence: Fence, lo: int, hi: int, shards: int, optimistic: bool) -> int:
    """Least capacity in [lo, hi] whose greedy pass reaches the end."""
    return lo + bisect_left(range(lo, hi), True, key=lambda c: fence.cuts(c, shards, optimistic)[-1] == fence.known[-1])


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int, fence: int = FENCE) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the prefix sums after which its greedy pass cuts."""
    lo, hi = max(-(-total // shards), largest), -(-total // shards) + largest
    windows = [(0, total)]
    while True:
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("upto").between(a, b)
        near = sums.filter(inside)
        width = max(1, -(-sum(b - a + 1 for a, b in windows) // fence))
        cells = near.groupBy(F.floor(F.col("upto") / F.lit(width)).alias("c")).agg(
            F.min("upto").alias("a"), F.max("upto").alias("b"), F.count(F.lit(1)).alias("n"))
        known = Fence([(r.a, r.b, r.n) for r in cells.select("a", "b", "n").collect()], total)  # fence + windows rows at most
        least, most = smallest(known, lo, hi, shards, True), smallest(known, lo, hi, shards, False)
        first, last = known.cuts(least, shards, False), known.cuts(most, shards, True)
        if least == most and first == last:
            return most, sorted(set(first) - {total})
        lo, hi, spans = least, most, sorted(zip(first, last, strict=True))
        windows = []
        for a, b in spans:
            if windows and a <= windows[-1][1] + 1:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))


def minimax_shards(rows: DataFrame, shards: int = 40, fence: int = FENCE) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in a shard) to rows with ``doc_id, size, key``.

    Ties and repeated rows keep a place each. With fewer groups than shards some shards stay empty.
    An empty table gives an empty table.
    """
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total, = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()
    own, left, rest = [], shards, total
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():  # at most one per shard
        if left > 1 and r.bytes * left > rest:
            own.append(bytes(r.key))
            left, rest = left - 1, rest - r.bytes
    others = groups.filter(~F.col("key").isin(own)) if own else groups
    bounds: list[bytes] = []
    if rest > 0:
        largest, = others.agg(F.max("bytes")).first()
        sums = materialise(prefix_sums(others))
        _, cuts = minimax_cuts(sums, rest, largest, left, fence)
        bounds = sorted(bytes(r.key) for r in sums.filter(F.col("upto").isin(cuts)).select("key").collect()) if cuts else []
    shard: Column = F.lit(len(own))
    for b in bounds:
        shard = shard + (F.col("key") > F.lit(b)).cast("int")
    for i, k in enumerate(own):
        shard = F.when(F.col("key") == F.lit(k), F.lit(i)).otherwise(shard)
    ranked = range_rank(rows.withColumn("shard", shard.cast("int")), [F.col("shard"), F.col("key"), F.col("doc_id")])
    starts = {r.shard: r.first for r in ranked.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # one per shard
    first = F.array(*[F.lit(starts.get(i, 1)).cast("long") for i in range(shards)])
    return ranked.withColumn("slot", F.col("rank") - F.element_at(first, F.col("shard") + 1)).drop("rank", "total")
