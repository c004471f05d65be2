"""Pairwise correlation and the redundancy advice built on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.schema import col, nan_to_null, numeric_columns
from tablewright.functions.stats import pair_corr, pair_count

PAIRS_PER_SCAN = 150
WIDE = 60
SCHEMA = "pair bigint, feature_a string, feature_b string, correlation double, n bigint"


def correlation_long(
    df: DataFrame, label: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """``pair, feature_a, feature_b, correlation, n`` for every column pair, label last.

    Pairwise-complete moments in one aggregation. Tables wider than ``WIDE`` columns use
    one distributed Gramian for the columns without NULLs and pair moments for the rest.
    """
    df = nan_to_null(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    if label in names:
        names = [c for c in names if c != label] + [label]
    pairs = list(enumerate(combinations(names, 2)))
    if not pairs:
        return df.sparkSession.createDataFrame([], SCHEMA)
    frames = []
    facts = df.agg(*[_facts(c).alias(f"c{i}") for i, c in enumerate(names)]).first()
    fact = dict(zip(names, facts, strict=True))
    full = {c for c in names if fact[c]["gaps"] == 0}
    if len(names) > WIDE:
        frames.append(_gramian(df, [p for p in pairs if full.issuperset(p[1])], [c for c in names if c in full]))
        pairs = [p for p in pairs if not full.issuperset(p[1])]
    for i in range(0, len(pairs), PAIRS_PER_SCAN):
        part = pairs[i : i + PAIRS_PER_SCAN]
        cells = []
        for k, (a, b) in part:
            x, y = col(a).cast("double"), col(b).cast("double")
            if not full.issuperset((a, b)):
                r, n = pair_corr(x, y), pair_count(x, y)
            elif fact[a]["lo"] == fact[a]["hi"] or fact[b]["lo"] == fact[b]["hi"]:
                r, n = F.lit(None).cast("double"), F.count(F.lit(1))
            else:
                r, n = _centred_corr(x - F.lit(fact[a]["mid"]), y - F.lit(fact[b]["mid"])), F.count(F.lit(1))
            cells.append(
                F.struct(
                    F.lit(k).cast("bigint").alias("pair"),
                    F.lit(a).alias("feature_a"),
                    F.lit(b).alias("feature_b"),
                    r.alias("correlation"),
                    n.alias("n"),
                ).alias(f"p{k}")
            )
        frames.append(df.agg(*cells).select(F.inline(F.array(*[f"p{k}" for k, _ in part]))))
    return reduce(DataFrame.unionByName, frames)


def _facts(c: str) -> Column:
    x = col(c).cast("double")
    return F.struct(
        F.count_if(x.isNull()).alias("gaps"), F.avg(x).alias("mid"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )


def _centred_corr(x: Column, y: Column) -> Column:
    """Pearson from plain sums, which is safe once both columns are centred on their means.

    One product sum per pair; the other sums are shared by all pairs of a column.
    """
    n = F.count(F.lit(1))
    xy = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    xx, yy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))


def _gramian(df: DataFrame, pairs: list, names: list[str]) -> DataFrame:
    """Matrix of the NULL-free columns; its size depends on the column count only."""
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(
        df.select(*[col(c).cast("double").alias(c) for c in names])
    )
    m = Correlation.corr(vec, "v").first()[0].toArray()
    rows = df.count()
    at = {c: i for i, c in enumerate(names)}
    out = []
    for k, (a, b) in pairs:
        r = float(m[at[a], at[b]])
        out.append((k, a, b, None if r != r else r, rows))
    return df.sparkSession.createDataFrame(out, SCHEMA)


def correlated_pairs(corr: DataFrame, threshold: float = K.CORRELATION_THRESHOLD) -> DataFrame:
    """Pairs with ``|r| >= threshold``, strongest first (ties in column order)."""
    return (
        corr.where(F.abs("correlation") >= threshold)
        .withColumn("correlation", F.round("correlation", 6))
        .orderBy(F.desc(F.abs("correlation")), "pair")
    )


def drop_recommendations(
    corr: DataFrame, label: str, threshold: float = K.CORRELATION_THRESHOLD
) -> DataFrame:
    """For each correlated feature pair, advise dropping the side closer to zero against the label.

    The first pair (by ``|r|``) wins per dropped feature. ``corr`` has one row per column
    pair, so every frame here is bounded by the square of the column count.
    """
    pairs = correlated_pairs(corr, threshold).where(
        (F.col("feature_a") != label) & (F.col("feature_b") != label)
    )
    # the label is always last, so it can only be feature_b
    to_label = corr.where(F.col("feature_b") == label).select(
        F.col("feature_a").alias("f"), F.abs("correlation").alias("r")
    )
    joined = pairs.join(to_label.toDF("feature_a", "ra"), "feature_a").join(
        to_label.toDF("feature_b", "rb"), "feature_b"
    )
    drop_a = F.coalesce(F.col("ra") <= F.col("rb"), F.lit(False))
    low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
    advice = joined.select(
        "pair",
        F.when(drop_a, F.col("feature_a")).otherwise(F.col("feature_b")).alias("feature"),
        F.when(drop_a, F.col("feature_b")).otherwise(F.col("feature_a")).alias("correlated_with"),
        F.col("correlation").alias("pair_correlation"),
        F.round(low, 6).alias("label_correlation"),
        F.round(high, 6).alias("kept_label_correlation"),
    )
    first = Window.partitionBy("feature").orderBy(F.desc(F.abs("pair_correlation")), "pair")
    return (
        advice.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .withColumn(
            "reason",
            F.format_string(
                "correlates with '%s' (r=%.4f) and less with the label (%.4f vs %.4f)",
                "correlated_with",
                "pair_correlation",
                "label_correlation",
                "kept_label_correlation",
            ),
        )
        .drop("_n", "pair")
    )


def correlation_matrix(corr: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square matrix, columns in the given order; only for writing out."""
    both = corr.select("feature_a", "feature_b", "correlation").unionByName(
        corr.select(
            F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"
        )
    )
    wide = both.groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", list(columns)).agg(
        F.first("correlation")
    )
    return wide.select(
        "feature",
        *[F.when(F.col("feature") == c, F.lit(1.0)).otherwise(col(c)).alias(c) for c in columns],
    )
