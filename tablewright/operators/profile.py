"""Dataset profile: overview, missing values, numeric and categorical statistics, label."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.schema import (
    categorical_columns,
    col,
    is_classification,
    nan_to_null,
    numeric_columns,
    require_columns,
)
from tablewright.functions.stats import adjusted_kurtosis, adjusted_skew, pct
from tablewright.plans.attach import has_at_most
from tablewright.plans.selection import exact_quantiles

COLUMNS_PER_SCAN = 100
SUSPECT_GROUPS = 1_000_000


def per_column(
    df: DataFrame, columns: Sequence[str], build: Callable[[str], Column], chunk: int = COLUMNS_PER_SCAN
) -> DataFrame:
    """One row per column from one wide aggregation (one pruned scan per ``chunk`` columns).

    ``build`` returns a struct of aggregates for a column.
    """
    parts = [columns[i : i + chunk] for i in range(0, len(columns), chunk)]
    frames = [
        df.agg(*[build(c).alias(f"c{i}") for i, c in enumerate(part)]).select(
            F.inline(F.array(*[f"c{i}" for i in range(len(part))]))
        )
        for part in parts
    ]
    return reduce(DataFrame.unionByName, frames)


def duplicate_rows(df: DataFrame, suspect_groups: int = SUSPECT_GROUPS) -> int:
    """Rows that repeat an earlier row (NULLs compare equal).

    Whole rows are only shuffled when their 64-bit hash repeats, so a table without many
    copies moves eight bytes per row. Equality itself is checked on the full rows.
    """
    nulls = F.concat_ws("", *[col(c).isNull().cast("int").cast("string") for c in df.columns])
    hashed = df.withColumn("_h", F.xxhash64(nulls, *[col(c) for c in df.columns]))
    suspects = hashed.groupBy("_h").count().where("count > 1").select("_h")
    if has_at_most(suspects, suspect_groups):
        hashed = hashed.join(F.broadcast(suspects), "_h", "left_semi")
    groups = hashed.groupBy(*[col(c) for c in ["_h", *df.columns]]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first()["n"]


def overview(df: DataFrame) -> DataFrame:
    """One row: row and column counts, columns per type, duplicate rows."""
    types: dict[str, int] = {}
    for f in df.schema:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    type_map = F.create_map(*[F.lit(x) for kv in sorted(types.items()) for x in kv])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).alias("categorical_columns"),
        type_map.alias("dtype_breakdown"),
        F.lit(duplicate_rows(df)).cast("bigint").alias("duplicate_rows"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """``feature, missing_count, missing_pct`` for every column, most missing first."""
    df = nan_to_null(df)

    def build(c: str) -> Column:
        missing = F.count_if(col(c).isNull())
        return F.struct(
            F.lit(c).alias("feature"),
            missing.alias("missing_count"),
            pct(missing, F.count(F.lit(1))).alias("missing_pct"),
        )

    return per_column(df, df.columns, build).orderBy(F.desc("missing_pct"), "feature")


def numeric_profile(
    df: DataFrame, label: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Describe, adjusted skew and kurtosis, and fence outliers per numeric column.

    The label is included and marked. Quartiles are exact; the fences are literals by the
    time the statistics pass runs, so everything else is one aggregation.
    """
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def build(c: str) -> Column:
        x = col(c).cast("double")
        q1, q2, q3 = quartiles[c]
        if q1 is None:
            outliers = F.count_if(F.lit(False))
        else:
            reach = K.OUTLIER_FENCE * (q3 - q1)
            outliers = F.count_if((x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach)))
        rows = F.count(F.lit(1))
        return F.struct(
            F.lit(c).alias("feature"),
            F.lit(c == label).alias("is_label"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.lit(q1).cast("double").alias("q25"),
            F.lit(q2).cast("double").alias("median"),
            F.lit(q3).cast("double").alias("q75"),
            F.max(x).alias("max"),
            pct(F.count_if(x.isNull()), rows).alias("missing_pct"),
            F.round(adjusted_skew(x), 4).alias("skew"),
            F.round(adjusted_kurtosis(x), 4).alias("kurtosis"),
            outliers.alias("outlier_count"),
            pct(outliers, rows).alias("outlier_pct"),
        )

    return per_column(df, columns, build)


def categorical_profile(
    df: DataFrame, label: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Cardinality, missing cells and the most frequent value per non-numeric column.

    Values are counted before they are compared, and the top value is an aggregate rather
    than a window, so a near-unique column is spread over all tasks.
    """
    columns = (
        list(columns) if columns is not None else categorical_columns(df, [label] if label else [])
    )
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "feature string, nunique bigint, missing_count bigint, missing_pct double, "
            "top_value string, top_value_count bigint, top_value_pct double",
        )
    long = df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "feature", "value"
    )
    counts = long.groupBy("feature", "value").count()
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("count")).alias("n"), "value")))
    missing = F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0))
    rows = F.sum("count")
    top = F.coalesce(-best["n"], F.lit(0))
    return counts.groupBy("feature").agg(
        F.count("value").alias("nunique"),
        missing.alias("missing_count"),
        pct(missing, rows).alias("missing_pct"),
        best["value"].alias("top_value"),
        top.alias("top_value_count"),
        pct(top, rows).alias("top_value_pct"),
    )


def label_classes(df: DataFrame, label: str) -> DataFrame:
    """``class, count, pct`` of a classification label, largest class first."""
    rows = df.count()
    return (
        df.where(col(label).isNotNull())
        .groupBy(col(label).cast("string").alias("class"))
        .count()
        .withColumn("pct", pct(F.col("count"), F.lit(rows)))
        .orderBy(F.desc("count"), "class")
    )


def label_summary(df: DataFrame, label: str) -> DataFrame:
    """One row describing the label, for either task type."""
    df = nan_to_null(df)
    if label not in df.columns:
        return df.sparkSession.createDataFrame(
            [(f"column '{label}' was not found, so no label can be profiled",)], "error string"
        )
    dtype = dict(df.dtypes)[label]
    if is_classification(df, label, K.CLASSIFICATION_MAX_CLASSES):
        counts = df.groupBy(col(label).cast("string").alias("class")).count()
        known = F.when(F.col("class").isNotNull(), F.col("count"))
        rows = F.sum("count")
        return counts.agg(
            F.lit(label).alias("label"),
            F.lit(dtype).alias("dtype"),
            F.lit("classification").alias("type"),
            F.sum(F.when(F.col("class").isNull(), F.col("count")).otherwise(0)).alias("missing_count"),
            F.count("class").alias("nunique"),
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "count")))
                )
            ).alias("class_counts"),
            F.round(F.try_divide(F.max(known) * 100.0 / rows, F.min(known) * 100.0 / rows), 2).alias(
                "imbalance_ratio"
            ),
        )
    q = exact_quantiles(df, [label], [0.5])[label]
    x = col(label).cast("double")
    nunique = df.select(F.count_distinct(col(label)).alias("n")).first()["n"]
    return df.agg(
        F.lit(label).alias("label"),
        F.lit(dtype).alias("dtype"),
        F.lit("regression").alias("type"),
        F.count_if(x.isNull()).alias("missing_count"),
        F.lit(nunique).alias("nunique"),
        F.round(F.avg(x), 6).alias("mean"),
        F.round(F.lit(q[0]), 6).alias("median"),
        F.round(F.stddev_samp(x), 6).alias("std"),
        F.round(F.min(x), 6).alias("min"),
        F.round(F.max(x), 6).alias("max"),
        F.round(adjusted_skew(x), 4).alias("skew"),
    )


def quality_flags(
    df: DataFrame, label: str | None, numeric: DataFrame | None = None, missing: DataFrame | None = None
) -> DataFrame:
    """``feature, flag, value`` rows: low variance, high missing, outlier-heavy columns."""
    numeric = numeric_profile(df, label) if numeric is None else numeric
    missing = missing_values(df) if missing is None else missing
    low = numeric.where((F.col("std") < K.LOW_VARIANCE_STD) & ~F.col("is_label")).select(
        "feature", F.lit("low_variance").alias("flag"), F.col("std").alias("value")
    )
    gaps = missing.where(F.col("missing_pct") > K.HIGH_MISSING_PCT).select(
        "feature", F.lit("high_missing").alias("flag"), F.col("missing_pct").alias("value")
    )
    outliers = numeric.where(F.col("outlier_pct") > K.OUTLIER_COLUMN_PCT).select(
        "feature", F.lit("outliers").alias("flag"), F.col("outlier_pct").alias("value")
    )
    return low.unionByName(gaps).unionByName(outliers)


def missing_totals(missing: DataFrame) -> DataFrame:
    """Total missing cells and columns with any, from :func:`missing_values`."""
    return missing.agg(
        F.sum("missing_count").alias("total_missing_cells"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
    )


def deep_profile(df: DataFrame, label: str) -> DataFrame:
    """One row per feature with its skew or cardinality and a transform recommendation."""
    require_columns(df, [label], "deep_profile")
    names = numeric_columns(df, [label])
    text = categorical_columns(df, [label])
    frames = []
    if names:
        skew, out = F.coalesce("skew", F.lit(0.0)), F.col("outlier_pct")
        advice = F.array_compact(
            F.array(
                F.when(
                    (skew > 1.0) & (F.col("min") >= 0) & (F.col("missing_pct") == 0),
                    F.lit("long right tail and no negatives: try log"),
                ).when(skew < -1.0, F.lit("long left tail: mirror the values first if a log is wanted")),
                F.when(
                    out > K.OUTLIER_COLUMN_PCT,
                    F.concat(F.format_number(out, 1), F.lit("% of values beyond the fences: prefer splits to slopes")),
                ),
            )
        )
        frames.append(
            numeric_profile(df, label, names).select(
                "feature",
                F.lit("numeric").alias("kind"),
                F.round("skew", 3).alias("skew"),
                "outlier_pct",
                F.lit(None).cast("bigint").alias("cardinality"),
                F.lit(None).cast("string").alias("top_value"),
                F.when(F.size(advice) > 0, F.concat_ws("; ", advice))
                .otherwise("no action")
                .alias("recommendation"),
                F.when(
                    (skew > 1.0) & (F.col("min") >= 0) & (F.col("missing_pct") == 0), F.lit("log")
                ).alias("transform"),
            )
        )
    if text:
        n = F.col("nunique")
        frames.append(
            categorical_profile(df, label, text).select(
                "feature",
                F.lit("categorical").alias("kind"),
                F.lit(None).cast("double").alias("skew"),
                F.lit(None).cast("double").alias("outlier_pct"),
                n.alias("cardinality"),
                "top_value",
                F.when(n < 2, F.lit("one value only: carries nothing"))
                .when(n == 2, F.lit("two values: one indicator is enough"))
                .when(n <= 20, F.format_string("%d values: an indicator each", n))
                .when(
                    n <= 100,
                    F.format_string("%d values: indicators for the frequent ones, or a label mean", n),
                )
                .otherwise(F.format_string("%d values: a label mean, or leave it out", n))
                .alias("recommendation"),
                F.when(n.between(2, 20), F.lit("onehot")).alias("transform"),
            )
        )
    if not frames:
        raise ValueError("deep_profile: the table has no feature columns")
    return reduce(DataFrame.unionByName, frames)


def suggested_transforms(profile: DataFrame) -> dict[str, list[str]]:
    """Spec for ``apply_transformations`` from :func:`deep_profile` (one row per column)."""
    rows = profile.where("transform IS NOT NULL").select("transform", "feature").collect()
    spec: dict[str, list[str]] = {}
    for r in sorted(rows):
        spec.setdefault(r["transform"], []).append(r["feature"])
    return spec


def quick_profile(df: DataFrame, label: str, drop_advice: Sequence[str] = ()) -> DataFrame:
    """``feature, kind, missing_pct, advised_drop``: column lists, gaps and advice in one table."""
    require_columns(df, [label], "quick_profile")
    numeric, text = numeric_columns(df, [label]), categorical_columns(df, [label])
    name = F.col("feature")
    kind = (
        F.when(name == label, "label")
        .when(name.isin(numeric), "numeric")
        .when(name.isin(text), "categorical")
        .otherwise("other")
    )
    return missing_values(df).select(
        "feature",
        kind.alias("kind"),
        "missing_pct",
        name.isin(list(drop_advice)).alias("advised_drop"),
    )
