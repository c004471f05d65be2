"""Mixing sources to target weights.

Words per source are summed first (a source with a third of all rows is one partial sum per task), targets
follow from the weights with a ceiling of ``most_repeats`` times the source, and every document is taken
floor(rate) times plus once more when a number hashed from its id and a seed falls below the fraction. The
choice depends on nothing but the row, so reruns and lost executors cannot change it.

Null texts have size 0. A null source is a source of its own, last in order. A source without words has
target 0 and rate 0. Rows with equal ids draw alike; repeated rows are each mixed. An empty table gives an
empty mix. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_order
from tablewright.llm.common import null_safe, running
from tablewright.plans.attach import attach_group_stats
from tablewright.plans.lineage import cut

RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")
DIGITS = 12


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space: what is left of each, cut to one mark, is counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most_repeats: int = 3
) -> DataFrame:
    """Targets from one row per source (``_source``, ``_null``, ``source_size``).

    A source is held at its ceiling when its share of what is left would exceed it. Held sources only raise
    the share of the others, so the level rises until no more are held: one small aggregate per step.
    """
    placed = running(sizes, ["_null", "_source"], {"_place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    ceiling = (F.col("source_size") * most_repeats).cast("double")
    weighed = cut(placed.withColumns({"_weight": weight, "_ceiling": ceiling}))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(level) > F.col("_ceiling")
        row = weighed.agg(
            F.sum(F.when(above, F.col("_ceiling"))), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)
        ).first()
        if row[2] == held or not row[1]:
            break
        held, level = row[2], (total - (row[0] or 0.0)) / row[1]
    share = F.col("_weight") * F.lit(level)
    return weighed.withColumn("target", F.least(share, F.col("_ceiling"))).drop("_place", "_weight", "_ceiling")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = (1, 2, 3),
    most_repeats: int = 3,
    seed: int = 8,
) -> DataFrame:
    """Documents with size, source_size, target, rate, copies and taken words."""
    kept = [c for c in docs.columns if c not in RESULTS]
    name = F.col(f"`{source}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {"size": word_count(F.col(f"`{text}`")), "_key": null_safe(name)}
    )
    sums = rows.groupBy("_key", name.alias("_source")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_rows")
    )
    sums = cut(sums.withColumn("_null", F.col("_source").isNull()))
    n_rows = sums.agg(F.sum("_rows")).first()[0] or 0
    targets = source_targets(sums, weights, most_repeats).select("_key", "source_size", "target", "_rows")
    joined = attach_group_stats(rows, targets, ["_key"], "_rows", n_rows)
    draw = F.conv(F.substring(hash_order([key], seed), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(f"`{c}`") for c in kept], *RESULTS)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken."""
    times = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array()))
    return mixed.withColumn("_copy", times).drop("_copy", *RESULTS)
