"""Sharding by minimax contiguous partition (DataFrame functions only).

Atomic groups (rows of equal text) stand in one global order. The smallest capacity for which greedy cutting
needs at most ``shards`` shards is found by binary search, then the order is cut within it: greedy cuts show that it is
enough, and are moved so that every shard gets an even share of what is left, not the last one the rest. Greedy cutting only asks
for "the last group that ends at or before byte x", so the driver holds a bounded outline of the running sums
(at most ``OUTLINE`` points a look) and looks closer only at the few stretches in which a cut can fall.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import table, written, parallelism

#: Points of the running sums that one look brings to the driver, whatever the number of groups.
OUTLINE = 1 << 16
SALTS = 64


def _ordered(rows: DataFrame) -> DataFrame:
    """Groups in global order with the bytes and rows before each: (key, bytes, rows, b0, r0)."""
    n = parallelism(rows.sparkSession)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("first"))
    parts = written(groups.repartitionByRange(n, F.col("first").asc_nulls_first(), "key").withColumn("pid", F.spark_partition_id()), "shard-groups")
    sums = parts.groupBy("pid").agg(F.sum("bytes").alias("pb"), F.sum("rows").alias("pr"))  # one row a partition
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("pid", F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("ob"), F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("orow"))
    within = W.partitionBy("pid").orderBy(F.col("first").asc_nulls_first(), "key").rowsBetween(W.unboundedPreceding, -1)
    return parts.join(F.broadcast(offsets), "pid").select(
        "key", "bytes", "rows",
        (F.col("ob") + F.coalesce(F.sum("bytes").over(within), F.lit(0))).alias("b0"),
        (F.col("orow") + F.coalesce(F.sum("rows").over(within), F.lit(0))).alias("r0"),
    )


class _Ends:
    """Group ends (running sums) as far as they are known: points, and how many ends lie hidden before each point."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total = groups, total
        self.points: list[int] = [0]
        self.hidden: list[int] = [0]
        self.look([(0, total)])

    def look(self, stretches: list[tuple[int, int]]) -> None:
        """Bring the ends within these half-open (a, b] stretches, as at most OUTLINE points in all."""
        end = F.col("b0") + F.col("bytes")
        width = max(1, -(-sum(b - a for a, b in stretches) // (OUTLINE // 2)))
        near = None
        for a, b in stretches:
            hit = (end > a) & (end <= b)
            near = hit if near is None else near | hit
        cell = F.floor((end - 1) / F.lit(width))
        got = self.groups.where(near).groupBy(cell.alias("cell")).agg(F.max(end).alias("e"), F.min(end).alias("e0"), F.count("*").alias("n")).collect()
        cells = sorted((r["e"], r["e0"], r["n"]) for r in got)
        keep = [(p, h) for p, h in zip(self.points, self.hidden) if not any(a < p <= b for a, b in stretches)]
        for e, e0, n in cells:
            keep.append((e, max(0, n - 2)))
            if n > 1 and e0 != e:
                keep.append((e0, 0))
        keep.sort()
        self.points, self.hidden = [p for p, _ in keep], [h for _, h in keep]

    def last(self, x: int) -> tuple[int, int]:
        """Lower and upper bound of the last end at or before x; equal when it is known."""
        i = bisect_right(self.points, x) - 1
        low = self.points[i]
        high = low if i + 1 >= len(self.points) or not self.hidden[i + 1] else min(x, self.points[i + 1] - 1)
        return low, high

    def cuts(self, capacity: int, shards: int, which: int) -> list[int] | None:
        """Greedy cuts with the lower (0) or upper (1) bounds; None if ``shards`` don't suffice."""
        at, out = 0, []
        for _ in range(shards):
            if at >= self.total:
                break
            nxt = self.last(at + capacity)[which]
            if nxt <= at:
                return None
            at = nxt
            out.append(at)
        return out if at >= self.total else None

    def smallest(self, low: int, high: int, shards: int, which: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, which) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def even(self, capacity: int, cuts: list[int], shards: int) -> list[int]:
        """Cuts at known ends within the capacity that leave each shard an equal share of what is left, or ``cuts`` if such don't fit.

        From a cut at or after the one that a greedy walk from the end would make, the rest fits the shards that remain.
        """
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.points[bisect_left(self.points, max(0, least[-1] - capacity))])
        least.reverse()
        at, out = 0, []
        for k in range(shards):
            if at >= self.total:
                break
            goal = at + -(-(self.total - at) // (shards - k))
            end = self.points[bisect_right(self.points, min(goal, at + capacity)) - 1]
            after = self.points[min(bisect_right(self.points, end), len(self.points) - 1)]
            if after <= at + capacity and after - goal < goal - end:
                end = after  # the nearer one
            if end <= at or end < least[k]:
                end = self.points[bisect_right(self.points, at + capacity) - 1]
            out.append(end)
            at = end
        fits = out and out[-1] == self.total and all(0 < b - a <= capacity for a, b in zip([0, *out], out))
        return out if fits else cuts


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and cuts (ends of shards, as running sums) that respect it and leave no shard short where they can."""
    ends = _Ends(groups, total)
    low, high = max(largest, -(-total // shards)), total
    while True:
        sure, hoped = ends.smallest(low, high, shards, 0), ends.smallest(low, high, shards, 1)
        if sure == hoped:
            at, doubt = 0, []
            for end in ends.cuts(sure, shards, 0):
                lo, hi = ends.last(at + sure)
                if lo != hi:
                    doubt.append((lo, at + sure))
                at = end
            if not doubt:
                return sure, ends.even(sure, ends.cuts(sure, shards, 0), shards)
        low, high = hoped, sure
        stretches, a, b = [], 0, 0
        for _ in range(shards):
            x, y = ends.last(a + low)[0], min(total, b + high)
            i = bisect_right(ends.points, y)
            y = ends.points[i] if i < len(ends.points) else y
            if a < total:
                stretches.append((x, y))
            a, b = x, min(total, b + high)
        merged: list[tuple[int, int]] = []
        for x, y in sorted(s for s in stretches if s[0] < s[1]):
            if merged and x <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
            else:
                merged.append((x, y))
        ends.look(merged)


def shard_contiguous(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity).

    size is the UTF-8 bytes of the text plus 8. Rows of equal text form one atomic group; groups are ordered by
    their smallest id and cut into at most ``shards`` contiguous runs whose largest byte sum is minimal (law
    ``bytes``). slot counts the rows of a shard from 0 in that order. A null text has no bytes and crc 0, and forms
    a group of its own, as the empty text does; null ids come first in their group; repeated rows each get a slot;
    an empty table gives an empty table; other columns are left out. A group larger than all others is one shard.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
    )
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "shard-rows")
    groups = written(_ordered(rows), "shard-order")
    top = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    total, largest = top["total"] or 0, top["largest"] or 0
    capacity, cuts = minimax_cuts(groups, total, largest, shards) if total else (0, [])
    ends = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]) if len(cuts) > 1 else F.array().cast("array<bigint>")
    groups = groups.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("b0"))).cast("int"))
    starts = groups.groupBy("shard").agg(F.min("r0").alias("s0"))  # at most one row a shard
    groups = groups.join(F.broadcast(starts), "shard").select("key", "shard", (F.col("r0") - F.col("s0")).alias("g0"))
    # rows within a group are numbered salt by salt, so that no group is numbered by one task
    counts = rows.groupBy("key", "salt").agg(F.count("*").alias("n"))
    salts = counts.withColumn("k0", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    places = groups.join(salts, "key").select("key", "salt", "shard", (F.col("g0") + F.col("k0")).alias("p0"))
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("key", "salt").orderBy(F.col("doc_id").asc_nulls_first())) - 1)
    return numbered.join(places, ["key", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("p0") + F.col("i")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_contiguous(table(spark, sf_dir, "documents")).drop("capacity")
