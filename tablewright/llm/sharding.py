"""Minimax contiguous partition of documents into shards.

Documents with one text form a group that no shard boundary cuts. Groups stand in the order of their text
digest, so a shard is a range of digests and a row finds its shard by comparing itself with the cut points.
The capacity is the smallest under which filling shards in order needs no more than asked for: found by
binary search, each step a greedy walk over the running totals of the group sizes.

The running totals stay on the cluster. The driver holds their extremes in a bounded number of value
ranges; a walk that ends in a range it can't tell apart has that range divided by one pruned job, so the
answer is exact without collecting the groups.

Null texts are a group of their own of 8 bytes a row (``text_crc32`` null) apart from the empty text. Repeated
rows stay together in a group. An empty table has no rows and no cuts. One group may exceed the mean shard;
the capacity is then at least its size. Input columns named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import running
from tablewright.plans.lineage import cut

ROW_OVERHEAD = 8
FIRST_RANGES = 8_192
PARTS = 64
ROWS_PER_CELL = 50_000
CELLS_AT_LEAST = 64
RESULTS = ("size", "text_crc32", "shard", "slot")


@dataclass
class Totals:
    """Extremes of the running totals that end in value ranges ``[at, at + width)``."""

    at: list[int]
    width: list[int]
    low: list[int]
    high: list[int]

    def last_upto(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the largest total not above ``x``, and the range to divide when they differ."""
        i = bisect_right(self.at, x) - 1
        if i < 0:
            return 0, 0, None
        if x >= self.high[i]:
            return self.high[i], self.high[i], None
        if x < self.low[i]:
            before = self.high[i - 1] if i else 0
            return before, before, None
        return self.low[i], self.high[i], i


def _ranges(ends: DataFrame, spans: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int, int]]:
    """(at, width, low, high) of the non-empty parts of each span."""
    found = []
    for i in range(0, len(spans), 200):
        some = spans[i : i + 200]
        inside = F.lit(False)
        step, base = F.lit(None).cast("long"), F.lit(None).cast("long")
        for at, width in some:
            here = (F.col("_end") >= at) & (F.col("_end") < at + width)
            inside = inside | here
            step = F.when(here, F.lit(max(1, -(-width // parts)))).otherwise(step)
            base = F.when(here, F.lit(at)).otherwise(base)
        cells = ends.where(inside).select("_end", step.alias("_step"), base.alias("_base"))
        cell = F.col("_base") + F.expr("(_end - _base) div _step") * F.col("_step")
        rows = cells.groupBy(cell.alias("at"), F.col("_step").alias("width")).agg(F.min("_end"), F.max("_end")).collect()
        found += [tuple(r) for r in rows]
    return found


class Capacity:
    """Greedy walks over the running totals; ``ends`` has one ``_end`` (inclusive total) per group."""

    def __init__(self, ends: DataFrame, total: int, largest: int, shards: int) -> None:
        self.ends, self.total, self.largest, self.shards = ends, total, largest, shards
        self.known = Totals(*map(list, zip(*sorted(_ranges(ends, [(0, total + 1)], FIRST_RANGES)), strict=True)))

    def divide(self, which: set[int]) -> None:
        t = self.known
        fresh = _ranges(self.ends, [(t.at[i], t.width[i]) for i in sorted(which)], PARTS)
        rows = [r for i, r in enumerate(zip(t.at, t.width, t.low, t.high, strict=True)) if i not in which] + fresh
        self.known = Totals(*map(list, zip(*sorted(rows), strict=True)))

    def walk(self, capacity: int) -> tuple[list[int], list[int], set[int]]:
        """Cut positions at their lowest and highest, and the ranges that keep them apart."""
        low, high, vague = [0], [0], set()
        for _ in range(self.shards):
            a, b = self.known.last_upto(low[-1] + capacity), self.known.last_upto(high[-1] + capacity)
            low.append(a[0])
            high.append(b[1])
            vague |= {i for i in (a[2], b[2]) if i is not None}
        return low, high, vague

    def feasible(self, capacity: int) -> bool:
        while True:
            low, high, vague = self.walk(capacity)
            if low[-1] >= self.total:
                return True
            if high[-1] < self.total:
                return False
            self.divide(vague)

    def smallest(self) -> int:
        lo = max(self.largest, -(-self.total // self.shards))
        hi = lo + self.largest
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.feasible(mid) else (mid + 1, hi)
        return lo

    def cuts(self, capacity: int) -> list[int]:
        """Totals at which shards end, the last one's left out."""
        while True:
            low, high, vague = self.walk(capacity)
            if low == high:
                return [x for x in low[1:-1] if x < self.total]
            self.divide(vague)


def sizes(docs: DataFrame, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.drop(*RESULTS).withColumns(
        {
            "size": F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + ROW_OVERHEAD,
            "text_crc32": F.crc32(body.cast("binary")),
            "_digest": F.when(body.isNull(), F.lit(-(2**63))).otherwise(F.xxhash64(body)),
            "_crc": F.coalesce(F.crc32(body.cast("binary")), F.lit(-1)).cast("long"),
        }
    )


def shard_of(points: list[tuple[int, int]]) -> Column:
    """Shards are ranges of (digest, crc); ``points`` are the first groups of shards 1 and up."""
    out = F.lit(0)
    for digest, crc in points:
        at = (F.col("_digest") > digest) | ((F.col("_digest") == digest) & (F.col("_crc") >= crc))
        out = out + at.cast("int")
    return out


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 24) -> DataFrame:
    """Documents with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in a shard)."""
    rows = sizes(docs, text)
    groups = rows.groupBy("_digest", "_crc").agg(F.sum("size").alias("_size"))
    placed = cut(running(groups, ["_digest", "_crc"], {"_start": F.col("_size")}).withColumn("_end", F.col("_start") + F.col("_size")))
    total, largest = placed.agg(F.max("_end"), F.max("_size")).first()
    points: list[tuple[int, int]] = []
    if total:
        search = Capacity(placed.select("_end"), total, largest, shards)
        at = search.cuts(search.smallest())
        firsts = placed.where(F.col("_start").isin(at)).select("_digest", "_crc").collect() if at else []
        points = sorted((r[0], r[1]) for r in firsts)
    return number(rows.withColumn("shard", shard_of(points)), key).drop("_digest", "_crc")


def number(rows: DataFrame, key: str) -> DataFrame:
    """``slot``: position in the shard. Hashed cells of each shard are numbered on their own and then
    moved by the rows of the cells before them; the number of cells follows the number of rows."""
    n = rows.count()
    spark = rows.sparkSession
    cells = max(CELLS_AT_LEAST, -(-n // ROWS_PER_CELL), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.xxhash64(F.col(f"`{key}`"), "_digest"), F.col(f"`{key}`"), F.col("_digest")]
    celled = rows.withColumn("_cell", F.pmod(order[0], F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("shard", "_cell").count()
    starts = starts.select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("shard", "_cell").orderBy(*order)
    numbered = celled.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["shard", "_cell"])
    names = [c for c in rows.columns if c != "shard"]
    return numbered.select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("_from") + F.col("_at")).cast("long").alias("slot"))
