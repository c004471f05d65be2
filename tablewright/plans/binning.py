"""Assigning many columns to sorted edges at once.

A conditional count per edge makes one huge generated method out of a wide table. Here each
value finds its bin by binary search, and ``(feature, bin)`` pairs are counted; partial
aggregation leaves at most one row per pair and task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned_long(
    df: DataFrame, values: Mapping[str, Column], edges: Mapping[str, Sequence[float]], keep: Sequence[str] = ()
) -> DataFrame:
    """``keep..., feature, bin, x`` for every non-null value.

    ``bin`` is the number of edges at or below the value. ``values`` gives a double
    expression per feature.
    """
    names = list(values)
    frame = df.select(*keep, *[values[f].cast("double").alias(f"_x{i}") for i, f in enumerate(names)])
    cells = []
    cut = [(i, f) for i, f in enumerate(names) if len(edges[f])]
    if cut:
        frame = Bucketizer(
            splitsArray=[[float("-inf"), *edges[f], float("inf")] for _, f in cut],
            inputCols=[f"_x{i}" for i, _ in cut],
            outputCols=[f"_b{i}" for i, _ in cut],
            handleInvalid="keep",
        ).transform(frame)
    for i, f in enumerate(names):
        number = F.col(f"_b{i}") if len(edges[f]) else F.lit(0)
        cells.append(
            F.struct(F.lit(f).alias("feature"), number.cast("int").alias("bin"), F.col(f"_x{i}").alias("x"))
        )
    return frame.select(*keep, F.inline(F.array(*cells))).where("x IS NOT NULL")
