"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups are rows with equal texts, ordered by the 64-bit hash of the text. The smallest shard capacity for which a greedy
pass needs no more than the given number of shards is found by binary search, and the order is cut there.

The table of groups never leaves the executors. The driver holds sizes of hash ranges, at first 4096 of them; a range in
which a cut would fall is replaced by its 64 subranges until every cut stands between two groups, which gives the exact
optimum over the groups.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm import common

FIRST_BITS, MORE_BITS = 12, 6


@dataclass(frozen=True)
class Range:
    """Hash range [low, low + 2**(64 - bits)) in signed order, with what it holds."""

    low: int
    bits: int
    size: int
    groups: int

    @property
    def whole(self) -> bool:
        """No cut can fall inside."""
        return self.groups <= 1 or self.bits >= 64


def _aggregated(groups: DataFrame, bits: int, inside: list[Range] | None = None) -> list[Range]:
    shift = 64 - bits
    prefix = F.shiftright("h", shift) if shift else F.col("h")
    if inside:
        same = 64 - inside[0].bits
        groups = groups.where((F.shiftright("h", same)).isin([r.low >> same for r in inside]))
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).collect()
    return sorted((Range(r.p << shift, bits, int(r["size"]), int(r.groups)) for r in rows), key=lambda r: r.low)


def _greedy(ranges: list[Range], sums: list[int], capacity: int, start: int = 0, split: bool = True) -> int:
    """Shards that a greedy pass from byte `start` needs; split: ranges of several groups count as divisible."""
    n, at, total = 0, start, sums[-1]
    while at < total:
        i = bisect_right(sums, at + capacity) - 1  # sums[i] <= at + capacity
        reach = sums[i]
        if split and i < len(ranges) and not ranges[i].whole:
            reach = at + capacity
        if reach <= at:
            return 1 << 60
        at, n = reach, n + 1
    return n


def minimax_cuts(ranges: list[Range], shards: int) -> tuple[list[int], set[int], int]:
    """Byte positions of the cuts, the indices of ranges that have to be refined first, and the capacity.

    Ranges of several groups count as divisible, so the capacity is a lower bound; it is the optimum once no cut falls
    inside one. Given the capacity, each shard ends near the mean of what is left, so that the last ones aren't empty.
    """
    sums = [0]
    for r in ranges:
        sums.append(sums[-1] + r.size)
    total = sums[-1]
    low, high = max([-(-total // shards), 1, *(r.size for r in ranges if r.whole)]), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if _greedy(ranges, sums, mid) <= shards:
            high = mid
        else:
            low = mid + 1
    cuts, refine, at = [], set(), 0
    for left in range(shards - 1, 0, -1):
        aim = at + (total - at + left) // (left + 1)
        i = bisect_right(sums, aim) - 1
        options = []
        for reach, inside in ((sums[i], None), (sums[min(i + 1, len(ranges))], None), (aim, i)):
            if inside is not None and (i >= len(ranges) or ranges[i].whole or sums[i] == aim):
                continue
            if reach - at <= low and _greedy(ranges, sums, low, reach) <= left:
                options.append((abs(reach - aim), inside is None, reach, inside))
        if not options:  # the longest step is always feasible
            i = bisect_right(sums, at + low) - 1
            inside = i if i < len(ranges) and not ranges[i].whole and sums[i] < at + low else None
            options.append((0, True, sums[i] if inside is None else at + low, inside))
        _, _, at, inside = min(options, key=lambda o: o[:3])
        if inside is not None:
            refine.add(inside)
        cuts.append(at)
    return cuts, refine, low


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes at which the shards after the first begin, and the capacity. groups: h, size."""
    ranges = _aggregated(groups, FIRST_BITS)
    while True:
        cuts, refine, capacity = minimax_cuts(ranges, shards)
        if not refine:
            break
        bits = min(ranges[i].bits for i in refine)
        chosen = [ranges[i] for i in refine if ranges[i].bits == bits]
        finer = _aggregated(groups, min(64, bits + MORE_BITS), chosen)
        gone = set(chosen)
        ranges = sorted([r for r in ranges if r not in gone] + finer, key=lambda r: r.low)
    begins, total, at = [], 0, 0
    for r in ranges:
        while at < len(cuts) and cuts[at] <= total:
            begins.append(r.low)
            at += 1
        total += r.size
    return begins + [None] * (len(cuts) - len(begins)), capacity


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard and its slot there: doc_id, size, text_crc32, shard, slot.

    A row's size is its text's UTF-8 bytes plus 8. Rows with equal texts stay together; null and empty texts are equal
    here. Where there are fewer groups than shards, or one group exceeds the mean, some shards may be empty. Slots follow
    (hash, doc_id) and are gapless; repeated rows get slots of their own. An empty table gives no rows. Only the named
    columns are read, so others may have any name.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = common.written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(whole) + 8).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("h"),
        ),
        "shard-rows",
    )
    groups = common.written(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    begins, _ = plan_cuts(groups, shards)
    bounds = [F.when(F.col("h") >= F.lit(b), 1).otherwise(0) for b in begins if b is not None]
    numbered = reduce(lambda a, b: a + b, bounds, F.lit(0)).cast("int")

    # Slots: hash ranges hold a bounded part of the rows each; a range with more is dealt out further by the id, so that
    # a group of copies of any size spreads. Rows are counted in each cell, and cells in order.
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    target = min(1_000_000, max(64, total // (8 * common.partitions(spark))))
    cell = F.shiftright("h", 64 - FIRST_BITS)
    counts = {r.c: r.n for r in groups.groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect()}  # 4096 at most
    heavy = {c: -(-n // target) for c, n in counts.items() if n > target}
    deals = spark.createDataFrame([(int(c), int(k)) for c, k in heavy.items()], "cell int, parts int")  # 4096 rows at most
    dealt = rows.withColumns({"shard": numbered, "cell": cell.cast("int")}).join(F.broadcast(deals), "cell", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.coalesce("parts", F.lit(1))).cast("int"))
    # A cut may fall inside a range of hashes, so that the shard belongs to the key of a cell.
    sizes = dealt.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    before: dict[tuple, int] = {}
    filled: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r["shard"], r.cell, r.part)):
        before[r["shard"], r.cell, r.part] = filled.get(r["shard"], 0)
        filled[r["shard"]] = filled.get(r["shard"], 0) + r.n
    offsets = spark.createDataFrame([(*k, v) for k, v in before.items()], "shard int, cell int, part int, base long")
    order = Window.partitionBy("shard", "cell", "part").orderBy("h", "doc_id", "size", "text_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(order) - 1)
        .join(F.broadcast(offsets), ["shard", "cell", "part"])  # 4096 + 24 cells, and 8 a shuffle partition or one a million rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))
    )
