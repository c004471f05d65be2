"""Comparison of runs and of logged experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.schema import order_columns
from tablewright.sources import readers

# Columns shown first in a comparison, in this order.
PRIORITY = (
    "run_id",
    "problem_type",
    "eval_metric",
    "best_model",
    "best_test_score",
    "n_models",
    "n_features",
    "total_fit_time",
)
MAX_PARAMETERS = 2_000


def top_features(importance: DataFrame, k: int = 5) -> DataFrame:
    """``run_id, feature, importance, rank`` of each run's ``k`` most important features."""
    order = Window.partitionBy("run_id").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def run_summary(
    info: DataFrame | None = None,
    analysis: DataFrame | None = None,
    test_board: DataFrame | None = None,
    board: DataFrame | None = None,
    importance: DataFrame | None = None,
    cv: DataFrame | None = None,
) -> DataFrame:
    """One row per run from whichever artifacts exist; a missing one leaves NULLs.

    Every artifact is first reduced to one row per run, then the rows are outer-joined.
    """
    parts = []
    if info is not None:
        parts.append(
            info.select(
                "run_id", "problem_type", "eval_metric", "best_model", F.size("features").alias("n_features"), "features"
            )
        )
    if analysis is not None:
        parts.append(
            analysis.select(
                "run_id",
                F.size("findings").alias("n_findings"),
                F.size("recommendations").alias("n_recommendations"),
            )
        )
    if test_board is not None:
        parts.append(
            test_board.groupBy("run_id").agg(
                F.max("score_test").alias("best_test_score"), F.count(F.lit(1)).alias("n_models")
            )
        )
    if board is not None and "fit_time" in board.columns:
        parts.append(board.groupBy("run_id").agg(F.round(F.sum("fit_time"), 2).alias("total_fit_time")))
    if importance is not None:
        named = F.sort_array(F.collect_list(F.struct("rank", "feature")))
        parts.append(
            top_features(importance).groupBy("run_id").agg(F.transform(named, lambda x: x["feature"]).alias("top_5_features"))
        )
    if not parts:
        raise ValueError("run_summary: no artifacts")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "run_id", "full_outer")
    if cv is not None:
        out = out.join(cv_columns(cv), "run_id", "full_outer")
    return order_columns(out, PRIORITY)


def cv_columns(cv: DataFrame) -> DataFrame:
    """``cv_<metric>_mean`` and ``cv_<metric>_std`` from ``n_folds`` and the score map."""
    named = cv.select(F.explode(F.map_keys("aggregate_scores")).alias("m")).distinct()
    metrics = [r["m"] for r in named.limit(MAX_PARAMETERS + 1).collect()]
    if len(metrics) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} different metrics")
    cells = [
        F.try_element_at("aggregate_scores", F.lit(m))[part].alias(f"cv_{m}_{part}")
        for m in sorted(metrics)
        for part in ("mean", "std")
    ]
    return cv.select("run_id", F.col("n_folds").alias("cv_folds"), *cells)


def compare_runs(spark: SparkSession, base: str) -> DataFrame:
    """Summary of every run directory under ``base``: one scan per artifact kind and header."""

    def read(name: str, schema: str | None = None) -> DataFrame | None:
        return readers.read_run_artifact(spark, base, name, schema)

    importance = read("feature_importance.csv")
    if importance is not None:
        importance = importance.withColumnRenamed(importance.columns[0], "feature")
        if "importance" not in importance.columns:
            importance = None
    return run_summary(
        read("model_info.json", readers.MODEL_INFO_SCHEMA),
        read("analysis.json", readers.ANALYSIS_SCHEMA),
        read("leaderboard_test.csv"),
        read("leaderboard.csv"),
        importance,
        read("cv_summary.json", readers.CV_SCHEMA),
    )


def last_experiments(log: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` latest entries in time order (all of them without ``n``)."""
    if n is None:
        return log
    return log.orderBy(F.desc("timestamp"), F.desc("output_dir")).limit(n).orderBy("timestamp", "output_dir")


def compare_experiments(log: DataFrame, last_n: int | None = None) -> DataFrame:
    """One row per entry with ``param_*`` and ``metric_*`` columns, absent keys NULL.

    Only the key names are gathered first; values stay in place, so nothing is pivoted.
    """
    entries = last_experiments(log, last_n)

    def keys(column: str) -> list[str]:
        names = entries.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(MAX_PARAMETERS + 1).collect()
        if len(names) > MAX_PARAMETERS:
            raise ValueError(f"more than {MAX_PARAMETERS} different {column}")
        return sorted(r["k"] for r in names)

    cells = [F.try_element_at("params", F.lit(k)).alias(f"param_{k}") for k in keys("params")]
    cells += [F.try_element_at("metrics", F.lit(k)).alias(f"metric_{k}") for k in keys("metrics")]
    more = []
    if "model_info" in log.columns:
        more = [F.col("model_info.best_model").alias("best_model"), F.col("model_info.problem_type").alias("problem_type")]
    return entries.select("timestamp", "output_dir", *cells, *more)


def top_leaderboard(board: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows by test score."""
    columns = [c for c in ("model", "score_val", "score_test", "fit_time") if c in board.columns]
    return board.orderBy(F.desc_nulls_last("score_test"), "model").limit(n).select(*columns)
