"""Sharding by minimax contiguous partition.

Equal texts form an atomic group.  Groups are ordered by a 64-bit hash of the text, and that order is
cut into ``shards`` contiguous runs so that the largest run is as small as any such cut allows: a binary
search over the capacity, each candidate checked by filling shards greedily.

The order is never collected.  The driver holds a histogram of it (sum and largest group per interval
of the hash) and walks the greedy check over that.  An interval in which some capacity of the current
search range would cut is opened into finer intervals, by one aggregation over the group table per
level, until cuts fall between single groups.  Of all cuts within the smallest capacity those nearest
to equal shares are taken, so that the last shard isn't left with the remainder alone.  Each level opens at most ``shards`` x a few intervals
per open capacity, so the driver's table keeps the same size whatever the input.

Slots count from 0 without gaps inside a shard.  They are row numbers within (shard, salt), where the
salt is a hash of id and text, plus the counts of lower salts, so neither a shard nor a hot group of copies
nor an id that many texts share is numbered in one task.

Defined results: null text has size ``overhead`` and forms one group, apart from the empty text; null
ids are placed like any other; repeated rows get slots of their own; an empty table gives an empty
table; with fewer groups than shards the last shards stay empty.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_TOP = 1 << 64
_FLIP = 1 << 63


class _Order:
    """The ordered groups as intervals of the hash, finer where cuts may fall: (start, end, sum, groups, largest)."""

    def __init__(self, groups: DataFrame, first_bits: int, step_bits: int):
        self.groups, self.step = groups, step_bits
        self._set(self._read(None, 64, 64 - first_bits))

    def _read(self, starts: list[int] | None, width: int, shift: int) -> list[tuple[int, int, int, int, int]]:
        """Intervals of 2**shift hashes that hold groups, of the intervals of 2**width hashes at the given starts."""
        groups, bits = self.groups, 64 - shift
        if starts is not None:
            top = 1 << (64 - width)
            numbers = [(a >> width) - (top if 2 * (a >> width) >= top else 0) for a in starts]
            groups = groups.where(F.shiftright("key", width).isin(numbers))
        rows = groups.groupBy(F.shiftright("key", shift).alias("k")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).collect()
        number = lambda r: r.k % (1 << bits)
        return [(number(r) << shift, (number(r) + 1) << shift, int(r.s), r.n, int(r.m)) for r in rows]

    def _set(self, rows) -> None:
        self.rows = sorted(rows, key=lambda r: (r[0] + _FLIP) % _TOP)  # the signed order of the hash
        self.prefix = [0, *itertools.accumulate(r[2] for r in self.rows)]

    def refine(self, wanted: set[int]) -> None:
        by_width: dict[int, list[int]] = {}
        for i in wanted:
            by_width.setdefault((self.rows[i][1] - self.rows[i][0]).bit_length() - 1, []).append(self.rows[i][0])
        fresh = [r for width, starts in by_width.items() for r in self._read(starts, width, max(0, width - self.step))]
        self._set([r for i, r in enumerate(self.rows) if i not in wanted] + fresh)

    def fill(self, capacity: int, shards: int, whole: bool) -> list[int]:
        """Where greedy shards end, as sums before the cut.  whole: no interval is cut, so each end is at most the
        true one; else intervals of several groups are cut anywhere, so each is at least the true one."""
        ends, at = [], 0
        for _ in range(shards):
            reach = at + capacity
            j = bisect.bisect_right(self.prefix, reach) - 1
            if j < len(self.rows) and (whole or self.rows[j][3] == 1):
                reach = max(at, self.prefix[j])
            at = min(reach, self.prefix[-1])
            ends.append(at)
        return ends

    def even(self, capacity: int, goals: list[int]) -> list[int]:
        """Intervals that begin shards 1.., as near to the goals as the capacity allows before and behind them."""
        least, at = [], self.prefix[-1]
        for _ in goals:
            at = self.prefix[bisect.bisect_left(self.prefix, at - capacity)]
            least.append(at)
        starts, at = [], 0
        for goal, low in zip(goals, reversed(least), strict=True):
            reach = bisect.bisect_right(self.prefix, at + capacity) - 1
            first = bisect.bisect_left(self.prefix, max(at, low))
            j = bisect.bisect_left(self.prefix, goal, first, reach + 1)
            j = min((x for x in (j - 1, j) if first <= x <= reach), key=lambda x: abs(self.prefix[x] - goal), default=reach)
            starts.append(j)
            at = self.prefix[j]
        return starts

    def smallest(self, low: int, high: int, shards: int, whole: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards, whole)[-1] == self.prefix[-1] else (middle + 1, high)
        return high


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = 14, step_bits: int = 6) -> tuple[int, list[int]]:
    """(the smallest capacity, signed hashes at which shards 1.. begin) for ``key, size`` rows, one per group."""
    order = _Order(groups, first_bits, step_bits)
    if not order.rows:
        return 0, []
    total, largest = order.prefix[-1], max(r[4] for r in order.rows)
    low = max(largest, -(-total // shards))
    while True:
        low = order.smallest(low, total, shards, whole=False)
        high = order.smallest(low, total, shards, whole=True)
        if low == high:
            goals = [total * k // shards for k in range(1, shards)]
            coarse = {j for g in goals if (j := bisect.bisect_right(order.prefix, g) - 1) < len(order.rows) and order.rows[j][3] > 1 and order.rows[j][2] * 1000 > high}
            if coarse:
                order.refine(coarse)
                continue
            starts = order.even(high, goals)
            keys = [order.rows[j][0] for j in starts if j < len(order.rows)]
            return high, [k - _TOP if k >= _FLIP else k for k in keys]
        wanted: set[int] = set()
        for a, b in zip(order.fill(low, shards, whole=True), order.fill(high, shards, whole=False), strict=True):
            first, last = bisect.bisect_right(order.prefix, a) - 1, bisect.bisect_right(order.prefix, b) - 1
            wanted |= {i for i in range(first, min(last, len(order.rows) - 1) + 1) if order.rows[i][3] > 1}
        order.refine(wanted)


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, salts: int = 64) -> DataFrame:
    """One row per row of docs: ``doc_id, size, text_crc32, key, shard, slot``."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead
    key = F.coalesce(F.xxhash64(F.lit(1), text), F.lit(0).cast("bigint"))
    key = F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(key)
    crc = F.coalesce(F.crc32(text), F.lit(0).cast("bigint"))
    sized = materialize(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("key"), F.pmod(F.xxhash64(F.col("doc_id"), key), F.lit(salts)).cast("int").alias("salt")), "shard-sizes")
    groups = materialize(sized.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("key") >= F.lit(c)).cast("int")
    placed = sized.withColumn("shard", number.cast("int"))
    counts = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x salts rows, whatever the input.
    offsets = F.broadcast(counts.select("shard", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("offset")))
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "key")
    return (
        placed.withColumn("row", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("offset") + F.col("row")).cast("bigint").alias("slot"))
    )
