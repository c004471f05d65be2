"""Exact cut points of a hash order inside groups.

A split needs "the first r rows of each class in hash order". Ranking every row would
shuffle whole rows and put a class into one task. Instead the digest at rank r is found
from narrow counting passes, and rows are then assigned by comparing their own digest
with a handful of literals: no shuffle of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 50_000


def _digits(largest_group: int, cell_rows: int) -> int:
    digits = 0
    while digits < 6 and largest_group / 16**digits > cell_rows:
        digits += 1
    return digits


def hash_cuts(
    rows: DataFrame,
    targets: Mapping[object, Sequence[int]],
    largest_group: int,
    cell_rows: int = CELL_ROWS,
) -> dict[object, list[str]]:
    """Digest at each wanted rank (1-based, within the group).

    ``rows`` has columns ``g`` (group) and ``h`` (digest). ``targets`` is a small driver-side
    mapping from group to ranks. Equal digests share a rank range and stay together.
    """
    spark = rows.sparkSession
    flat = [(g, int(r)) for g, ranks in targets.items() for r in ranks if r > 0]
    found: dict[object, dict[int, str]] = {g: {} for g in targets}
    if flat:
        g_type = rows.schema["g"].dataType.simpleString()
        wanted = spark.createDataFrame(flat, f"g {g_type}, r bigint")
        digits = _digits(largest_group, cell_rows)
        cell = F.substring("h", 1, digits) if digits else F.lit("")
        # groups and cells are filtered by literal sets, which costs no join and no broadcast
        cells = rows.where(F.col("g").isin(list(found))).withColumn("cell", cell)
        if digits:
            # at most 16**digits rows per group: a bounded window over counts, not over rows
            sums = (
                cells.groupBy("g", "cell")
                .count()
                .withColumn("upto", F.sum("count").over(Window.partitionBy("g").orderBy("cell")))
                .withColumn("before", F.col("upto") - F.col("count"))
            )
            hits = (
                sums.join(F.broadcast(wanted), "g")
                .where("r > before AND r <= upto")
                .select("g", "cell", "r", "before")
                .collect()
            )
        else:
            hits = [(g, "", r, 0) for g, r in flat]
        wanted = spark.createDataFrame(
            [tuple(x) for x in hits], f"g {g_type}, cell string, r bigint, before bigint"
        )
        name = F.concat_ws("|", "cell", F.col("g").cast("string"))
        held = [x["n"] for x in wanted.select(name.alias("n")).collect()]
        in_cell = Window.partitionBy("g", "cell").orderBy("h")
        ranked = (
            cells.where(name.isin(sorted(set(held))))
            .groupBy("g", "cell", "h")
            .count()
            .withColumn("upto", F.sum("count").over(in_cell))
            .join(F.broadcast(wanted), ["g", "cell"])
            .where("r > before + upto - count AND r <= before + upto")
        )
        for x in ranked.select("g", "r", "h").collect():
            found[x["g"]][x["r"]] = x["h"]
    return {g: [found[g].get(int(r), "") for r in ranks] for g, ranks in targets.items()}


def segment_by_cuts(group: Column, digest: Column, cuts: Mapping[object, Sequence[str]]) -> Column:
    """How many of the group's cuts lie strictly before ``digest`` (a literal CASE, no join)."""
    expr = None
    for g, edges in cuts.items():
        passed = sum([(digest > F.lit(e)).cast("int") for e in edges], F.lit(0))
        cond = group.isNull() if g is None else group == F.lit(g)
        expr = F.when(cond, passed) if expr is None else expr.when(cond, passed)
    return expr if expr is not None else F.lit(0)
