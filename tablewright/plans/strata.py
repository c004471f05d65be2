"""Cut points of any number of classes, kept as a table instead of literals.

A class may be a handful of rows or most of the table. Class sizes are attached to the narrow rows by a join that salts
hot classes; a large class is counted by leading digits of the digest first, so that only the cells that hold a wanted
rank are ordered. Nothing about the classes reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.attach import attach_group_stats
from tablewright.plans.cuts import CELL_ROWS
from tablewright.plans.lineage import cut

MAX_DIGITS = 6


def totals_before(df: DataFrame, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come earlier in ``order``, which must have no ties.

    Rows are dealt to ranges of the order; each range sums on its own and gets the total of the ranges before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = F.sum(value).over(inside) - value + F.col("_offset")
    return parts.join(F.broadcast(offsets), "_part").withColumn(out, upto).drop("_part", "_offset")


def shared_out(classes: DataFrame, rows: int, total: int) -> DataFrame:
    """``classes`` (g, n) with ``ranks``: one rank each, that share ``total`` in proportion to ``n``.

    What rounding down leaves goes to the largest remainders, equal ones in class order.
    """
    exact = F.lit(total) * F.col("n") / F.lit(rows)
    parts = cut(classes.withColumns({"_whole": F.floor(exact), "_rest": exact - F.floor(exact)}))
    left = total - (parts.agg(F.sum("_whole")).first()[0] or 0)
    placed = totals_before(parts, [F.desc("_rest"), F.asc("g")], F.lit(1), "_at")
    more = (F.col("_at") < F.lit(left)).cast("long")
    return placed.select("g", "n", F.array(F.col("_whole") + more).alias("ranks"))


def dealt_out(classes: DataFrame, k: int) -> DataFrame:
    """``classes`` (g, n) with ``ranks``: the last rank of each fold but the final one.

    Classes are dealt to the folds round-robin, one after another in class order.
    """
    placed = totals_before(classes, [F.asc("g")], F.col("n"), "_start")
    # fold f gets row i of a class when (start + i) % k = f
    first = [F.pmod(F.lit(f) - F.col("_start"), F.lit(k)) for f in range(k - 1)]
    sizes = [F.floor((F.col("n") - a + F.lit(k - 1)) / F.lit(k)).cast("long") for a in first]
    ends = [reduce(lambda a, b: a + b, sizes[: f + 1]) for f in range(k - 1)]
    return placed.select("g", "n", F.array(*ends).alias("ranks"))


def cut_table(rows: DataFrame, targets: DataFrame, total: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``g, n, edges``: the digest at each of a class's ``ranks`` (1-based; rank 0 gives '').

    ``rows`` has ``g`` and ``h`` (digest), ``targets`` has ``g``, ``n`` and ``ranks``. Equal digests stay together.
    """
    targets = cut(targets)
    sized = attach_group_stats(rows, targets.select("g", "n"), ["g"], "n", total)
    digits = reduce(lambda a, b: a + b, [(F.col("n") > F.lit(cell_rows * 16**d)).cast("int") for d in range(MAX_DIGITS)])
    cells = sized.select("g", "h", F.substr("h", F.lit(1), digits).alias("cell"))
    # at most 16**MAX_DIGITS counts per class
    upto = F.sum("count").over(Window.partitionBy("g").orderBy("cell"))
    sums = cells.groupBy("g", "cell").count().withColumn("before", upto - F.col("count"))
    wanted = targets.select("g", F.posexplode("ranks").alias("i", "r")).where("r > 0")
    hits = cut(sums.join(wanted, "g").where("r > before AND r <= before + count").select("g", "cell", "i", "r", "before"))
    inside = F.sum("count").over(Window.partitionBy("g", "cell").orderBy("h"))
    held = cells.join(hits.select("g", "cell").distinct(), ["g", "cell"], "left_semi")
    ranked = held.groupBy("g", "cell", "h").count().withColumn("upto", inside)
    found = ranked.join(hits, ["g", "cell"]).where("r > before + upto - count AND r <= before + upto")
    edges = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("_edges"))
    known = F.transform("ranks", lambda _, i: F.coalesce(F.try_element_at("_edges", i), F.lit("")))
    return targets.join(edges, "g", "left").select("g", "n", known.alias("edges"))


def with_segment(df: DataFrame, group: Column, digest: Column, edges: DataFrame, total: int, out: str) -> DataFrame:
    """Add ``out``: how many of its class's edges lie strictly before a row's digest."""
    named = edges.select(F.col("g").alias("_stratum"), F.col("n").alias("_size"), F.col("edges").alias("_edges"))
    met = attach_group_stats(df.withColumn("_stratum", group), named, ["_stratum"], "_size", total)
    passed = F.size(F.filter("_edges", lambda e: digest > e))
    return met.withColumn(out, passed).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
