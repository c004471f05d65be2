"""Inspection of individual predictions: worst and best rows, error summaries, hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.schema import col
from tablewright.functions.stats import pair_corr
from tablewright.operators.evaluate import typed_key
from tablewright.plans.selection import exact_quantiles


def join_predictions(predictions: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-to-one join by row key; keys on one side only, or repeated, are an error."""
    sides = predictions.select(*key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        rows.select(*key, F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    n_pred, n_rows, bad = (
        sides.groupBy(*key)
        .agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
        .agg(F.sum("p"), F.sum("t"), F.count_if((F.col("p") != 1) | (F.col("t") != 1)))
        .first()
    )
    if n_pred != n_rows or bad:
        raise ValueError(
            f"Row count mismatch: {n_pred} predictions, {n_rows} rows, {bad} keys do not pair up"
        )
    extra = [c for c in rows.columns if c not in predictions.columns]
    return predictions.join(rows.select(*key, *extra), list(key))


def prob_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("prob_")]


def predicted_probability(df: DataFrame, predicted: str = "predicted") -> Column:
    """Probability of the predicted class; NULL when it has no ``prob_`` column."""
    key = typed_key(df, predicted)
    picks = [F.when(key == c.removeprefix("prob_"), col(c)) for c in prob_columns(df)]
    return F.coalesce(*picks).cast("double") if picks else F.lit(None).cast("double")


def with_confidence(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Add ``confidence``, ``top2_margin`` (two classes or more) and ``is_error``."""
    probs = prob_columns(df)
    out = df.withColumn("confidence", predicted_probability(df, predicted))
    if len(probs) >= 2:
        ordered = F.sort_array(F.array(*[col(c).cast("double") for c in probs]), asc=False)
        out = out.withColumn("top2_margin", F.round(ordered[0] - ordered[1], 4))
    return out.withColumn("is_error", typed_key(df, actual) != typed_key(df, predicted))


def flag_low_confidence(df: DataFrame, min_confidence: float | None) -> DataFrame:
    """Add ``flagged_low_confidence`` when a threshold is given and a confidence exists."""
    if min_confidence is None or "confidence" not in df.columns:
        return df
    return df.withColumn("flagged_low_confidence", F.col("confidence") < min_confidence)


def ranked_predictions(
    df: DataFrame, n: int = 20, worst: bool = True, tie: Sequence[str] = ()
) -> DataFrame:
    """Classification top-n: errors with the least confidence, or hits with the most."""
    marked = with_confidence(df)
    ties = [F.asc(c) for c in tie]
    if worst:
        return marked.orderBy(F.desc("is_error"), F.asc_nulls_last("confidence"), *ties).limit(n)
    return marked.where(~F.col("is_error")).orderBy(F.desc_nulls_last("confidence"), *ties).limit(n)


def class_error_shares(df: DataFrame) -> DataFrame:
    """``class, rows, errors, error_share, prevalence, overrepresented`` per actual class.

    A class is over-represented when its share of the errors is more than 1.5 times its
    share of the rows.
    """
    marked = with_confidence(df)
    per_class = marked.groupBy(typed_key(df, "actual").alias("class")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_error").alias("errors")
    )
    everything = Window.partitionBy(F.lit(0))  # one row per class by now
    share = F.try_divide("errors", F.sum("errors").over(everything))
    shares = per_class.select(
        "class",
        "rows",
        "errors",
        F.round(F.coalesce(share, F.lit(0.0)), 4).alias("error_share"),
        F.round(F.try_divide("rows", F.sum("rows").over(everything)), 4).alias("prevalence"),
    )
    over = (F.col("prevalence") > 0) & (F.col("error_share") > F.col("prevalence") * 1.5)
    return shares.withColumn("overrepresented", over)


def error_summary(df: DataFrame) -> DataFrame:
    """One row: errors, error rate, confident errors (> 0.9) and close calls."""
    marked = with_confidence(df)
    wrong = F.col("is_error")
    close = F.lit(False)
    if "top2_margin" in marked.columns:
        close = wrong & (F.col("top2_margin") < 0.1) & (F.col("confidence") < 0.6)
    return marked.agg(
        F.count_if(wrong).alias("error_count"),
        F.round(F.avg(wrong.cast("double")), 4).alias("error_rate"),
        F.count_if(wrong & (F.col("confidence") > 0.9)).alias("confident_errors"),
        F.count_if(close).alias("close_calls"),
    )


def error_hints(df: DataFrame) -> DataFrame:
    """``hint`` rows drawn from the class shares and the summary."""
    classes = class_error_shares(df).where("overrepresented").select(
        F.lit("overrepresented_class").alias("code"),
        F.format_string(
            "Class %s makes up %.1f%% of the errors but only %.1f%% of the rows",
            "class",
            F.col("error_share") * 100,
            F.col("prevalence") * 100,
        ).alias("hint"),
    )
    summary = error_summary(df)
    confident = summary.where("confident_errors > 0").select(
        F.lit("confident_errors").alias("code"),
        F.format_string(
            "%d wrong predictions were made with over 0.9 confidence: suspect noisy labels or leakage", "confident_errors"
        ).alias("hint"),
    )
    close = summary.where("close_calls > 0").select(
        F.lit("close_calls").alias("code"),
        F.format_string(
            "%d wrong predictions were near ties between two classes: more data or features may separate them",
            "close_calls",
        ).alias("hint"),
    )
    return classes.unionByName(confident).unionByName(close)


def with_residuals(df: DataFrame) -> DataFrame:
    """Add ``residual`` if absent, its absolute value, and its percentage of the actual value."""
    out = df if "residual" in df.columns else df.withColumn("residual", F.col("actual") - F.col("predicted"))
    out = out.withColumn("abs_residual", F.abs("residual"))
    return out.withColumn(
        "residual_pct", F.round(F.try_divide(F.col("abs_residual").cast("double"), "actual") * 100, 2)
    )


def ranked_residuals(
    df: DataFrame, n: int = 20, worst: bool = True, tie: Sequence[str] = ()
) -> DataFrame:
    """Regression top-n by absolute residual."""
    way = F.desc_nulls_last if worst else F.asc_nulls_last
    return with_residuals(df).orderBy(way("abs_residual"), *[F.asc(c) for c in tie]).limit(n)


def residual_summary(df: DataFrame) -> DataFrame:
    """One row: absolute-residual statistics, bias direction and correlation with the target."""
    rows = with_residuals(df)
    median = exact_quantiles(rows, ["abs_residual"], [0.5])["abs_residual"][0]
    mean, mae = F.avg("residual"), F.avg("abs_residual")
    actual, size = F.col("actual").cast("double"), F.col("abs_residual").cast("double")
    r = pair_corr(actual, size)
    return rows.agg(
        F.round(mae, 4).alias("mean_abs_residual"),
        F.round(F.lit(median), 4).alias("median_abs_residual"),
        F.round(F.max("abs_residual"), 4).alias("max_abs_residual"),
        F.round(mean, 4).alias("mean_residual"),
        F.when(F.abs(mean) > mae * 0.2, F.when(mean < 0, "over-predicting").otherwise("under-predicting")).alias("bias"),
        F.when(F.count(F.lit(1)) >= 20, F.round(r, 4)).alias("size_correlation"),
        F.coalesce((F.count(F.lit(1)) >= 20) & (F.abs(r) > 0.3), F.lit(False)).alias("heteroscedastic"),
    )


def residual_hints(df: DataFrame) -> DataFrame:
    summary = residual_summary(df)
    bias = summary.where("bias IS NOT NULL").select(
        F.lit("bias").alias("code"),
        F.format_string("the model is %s on average (mean residual %.2f)", "bias", "mean_residual").alias("hint"),
    )
    spread = summary.where("heteroscedastic").select(
        F.lit("heteroscedastic").alias("code"),
        F.format_string(
            "errors grow or shrink with the target (r %.2f): a log target may help", "size_correlation"
        ).alias("hint"),
    )
    return bias.unionByName(spread)
