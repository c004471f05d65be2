"""Population-stability drift between a training table and a scoring table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.schema import col, nan_to_null, numeric_columns
from tablewright.plans.binning import binned_long
from tablewright.plans.selection import exact_quantiles


def shared_numeric(train: DataFrame, other: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return sorted(set(numeric_columns(train, exclude)) & set(numeric_columns(other, exclude)))


def drift_edges(
    train: DataFrame, features: Sequence[str], bins: int = K.PSI_BINS
) -> dict[str, list[float]]:
    """Distinct quantile edges of each training column (no edges for an empty column)."""
    q = exact_quantiles(train, features, [i / bins for i in range(bins + 1)])
    return {f: sorted(set(v)) if v[0] is not None else [] for f, v in q.items()}


def bin_counts(x: Column, edges: Sequence[float]) -> Column:
    """Rows per bin: half-open, the last one closed; values outside are in no bin."""
    last = len(edges) - 2
    counts = []
    for i in range(last + 1):
        below = x <= F.lit(edges[i + 1]) if i == last else x < F.lit(edges[i + 1])
        counts.append(F.count_if((x >= F.lit(edges[i])) & below))
    return F.array(*counts) if counts else F.array().cast("array<bigint>")


def side_stats(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """``feature, n, mean, std, counts`` from one pass over a side.

    Moments are summed per bin around the middle edge, so they stay exact when combined.
    """
    df = nan_to_null(df)
    centre = {f: (v[len(v) // 2] if v else 0.0) for f, v in edges.items()}
    long = binned_long(df, {f: col(f) for f in edges}, edges)
    middle = F.lit(0.0)
    for f, c in centre.items():
        middle = F.when(F.col("feature") == f, F.lit(c)).otherwise(middle)
    d = F.col("x") - middle
    # the last bin is closed: values equal to the last edge go down one bin
    last = F.lit(None).cast("double")
    for f, v in edges.items():
        if v:
            last = F.when(F.col("feature") == f, F.lit(v[-1])).otherwise(last)
    closed = F.when(F.col("x") == last, F.col("bin") - 1).otherwise(F.col("bin"))
    per_bin = (
        long.groupBy("feature", closed.alias("bin"))
        .agg(F.count(F.lit(1)).alias("k"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    )
    n, total, squares = F.sum("k"), F.sum("s"), F.sum("q")
    stats = per_bin.groupBy("feature").agg(
        n.alias("n"),
        (total / n).alias("shift"),
        F.sqrt(F.try_divide(F.greatest(squares - total * total / n, F.lit(0.0)), n - 1)).alias("std"),
        F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"),
    )
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(centre[f]).alias("centre"),
            F.lit(max(0, len(v) - 1)).alias("bins"),
        )
        for f, v in edges.items()
    ]
    named = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    # bins 1..k lie between two edges; 0 and k + 1 are outside the training range
    inside = F.when(F.col("bins") > 0, F.sequence(F.lit(1), F.col("bins"))).otherwise(F.array().cast("array<int>"))
    counts = F.transform(inside, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return named.join(stats, "feature").select(
        "feature", "n", (F.col("centre") + F.col("shift")).alias("mean"), "std", counts.alias("counts")
    )


def array_total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def psi(expected: Column, actual: Column) -> Column:
    """PSI of two bin-count arrays; NULL when either holds no row, 0 for a single value."""

    def shares(counts: Column) -> Column:
        total = array_total(counts)
        return F.transform(counts, lambda x: F.greatest(F.try_divide(x, total), F.lit(K.PSI_CLIP)))

    terms = F.zip_with(shares(expected), shares(actual), lambda e, a: (a - e) * F.ln(a / e))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    empty = (array_total(expected) == 0) | (array_total(actual) == 0)
    return F.when(F.size(expected) == 0, F.lit(0.0)).when(~empty, F.round(total, 6))


def drift_status(value: Column) -> Column:
    """No row inside the training range (NULL) is the strongest drift there is."""
    return (
        F.when(value.isNull() | (value >= K.PSI_SIGNIFICANT), "significant_drift")
        .when(value >= K.PSI_MODERATE, "moderate_drift")
        .otherwise("no_drift")
    )


def detect_drift(
    train: DataFrame, predict: DataFrame, label: str | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """One row per shared numeric feature, worst first; columns empty on a side are skipped."""
    features = shared_numeric(train, predict, [*exclude, *([label] if label else [])])
    if not features:
        return train.sparkSession.createDataFrame(
            [],
            "feature string, psi double, status string, train_mean double, predict_mean double, "
            "mean_shift_pct double, train_std double, predict_std double, in_range_rows bigint, "
            "out_of_range_pct double",
        )
    edges = drift_edges(train, features)
    a = side_stats(train, edges).alias("a")
    b = side_stats(predict, edges).alias("b")
    both = a.join(b, "feature").where("a.n > 0 AND b.n > 0")
    value = psi(F.col("a.counts"), F.col("b.counts"))
    single = F.size("a.counts") == 0
    in_range = F.when(single, F.col("b.n")).otherwise(array_total(F.col("b.counts")))
    shift = F.abs(F.col("b.mean") - F.col("a.mean")) / F.abs(F.col("a.mean")) * 100
    return both.select(
        "feature",
        value.alias("psi"),
        drift_status(value).alias("status"),
        F.round("a.mean", 6).alias("train_mean"),
        F.round("b.mean", 6).alias("predict_mean"),
        F.round(F.when(F.col("a.mean") != 0, shift).otherwise(0.0), 2).alias("mean_shift_pct"),
        F.round("a.std", 6).alias("train_std"),
        F.round("b.std", 6).alias("predict_std"),
        in_range.alias("in_range_rows"),
        F.round((F.col("b.n") - in_range) * 100.0 / F.col("b.n"), 2).alias("out_of_range_pct"),
    ).orderBy(F.desc_nulls_first("psi"), "feature")


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: features checked, features per status, and the drifted ones, worst first."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    # NULL PSI sorts first: it stands for "nothing in range"
    rank = F.struct((-F.coalesce("psi", F.lit(float("inf")))).alias("k"), "feature")
    drifted = F.sort_array(F.collect_list(F.when(F.col("status") != "no_drift", rank)))
    return report.agg(
        F.count(F.lit(1)).alias("features_checked"),
        n("significant_drift"),
        n("moderate_drift"),
        n("no_drift"),
        F.transform(drifted, lambda x: x["feature"]).alias("drifted_features"),
    )
