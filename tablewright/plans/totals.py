"""Running totals over an ordered column without a one-task window.

The column is cut into value buckets whose edges come from a sketch. Each bucket sums on
its own, a window over the bucket totals (at most ``MAX_BUCKETS`` rows) gives every bucket
its offset, and the offsets are broadcast back. Rows are grouped by value before they are
bucketed, so one value holding most of the rows is still a single row here.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 20_000
FIRST_BUCKETS = 64


def weighted_edges(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS
) -> dict[float, int]:
    """Interior edges about ``rows_per_bucket`` rows apart, with how many quantile points each one is.

    An edge that is several points in a row stands for a value with that many buckets of rows.
    """

    def sketch(n: int) -> tuple[list[float], int]:
        points = [i / n for i in range(1, n)]
        return df.agg(
            F.percentile_approx(F.col(column).cast("double"), points, max(1_000, 10 * n)),
            F.count(column),
        ).first()

    edges, rows = sketch(FIRST_BUCKETS)
    need = min(max_buckets, math.ceil(rows / rows_per_bucket))
    if need > FIRST_BUCKETS:
        edges, _ = sketch(need)
    return dict(sorted(Counter(edges or []).items()))


def bucket_edges(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS
) -> list[float]:
    return list(weighted_edges(df, column, rows_per_bucket, max_buckets))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], out: str = "bucket") -> DataFrame:
    """Bucket number by binary search; lower edge inclusive."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)


def running_totals(
    grouped: DataFrame,
    column: str,
    values: Sequence[str],
    edges: Sequence[float],
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<value>`` (inclusive) and ``next_<value>`` (the following row's) per value column.

    ``grouped`` has one row per distinct non-null double ``column``.
    """
    b = with_bucket(grouped, column, edges, "_bucket")
    way = F.desc if descending else F.asc
    head = F.max_by if descending else F.min_by
    totals = b.groupBy("_bucket").agg(
        *[F.sum(v).alias(v) for v in values], *[head(v, column).alias(f"_head_{v}") for v in values]
    )
    order = Window.orderBy(way("_bucket"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.lead(f"_head_{v}").over(order).alias(f"_next_{v}") for v in values],
    )
    inside = Window.partitionBy("_bucket").orderBy(way(column))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {f"cum_{v}": F.sum(v).over(upto) + F.col(f"_off_{v}") for v in values}
    new |= {f"next_{v}": F.coalesce(F.lead(v).over(inside), F.col(f"_next_{v}")) for v in values}
    joined = b.join(F.broadcast(offsets), "_bucket").withColumns(new)
    return joined.drop("_bucket", *[f"_{x}_{v}" for v in values for x in ("off", "next")])
