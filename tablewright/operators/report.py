"""Composed operators: everything a training run or a scoring run reports, as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.schema import col, drop_columns
from tablewright.operators import correlation, drift, evaluate, explain, features, findings, splits, train
from tablewright.operators.runs import top_leaderboard
from tablewright.plans.lineage import cut
from tablewright.sources.writers import write_report, write_table


def run_findings(result: dict, fit_on: DataFrame, test: DataFrame, run_id: str = "run") -> DataFrame:
    """``run_id, code, severity, message`` for the result of ``train_and_evaluate``."""
    run, spark = result["run"], fit_on.sparkSession
    tag = F.lit(run_id)
    board = result["leaderboard_test"].withColumn("run_id", tag)
    best = spark.createDataFrame([(run_id, run.best)], "run_id string, best_model string")
    sizes = spark.createDataFrame(
        [(run_id, fit_on.count(), test.count(), len(run.features))],
        "run_id string, n_train bigint, n_test bigint, n_features bigint",
    )
    classes = None
    if run.classes:
        counts = fit_on.where(col(run.label).isNotNull()).groupBy(col(run.label).cast("string").alias("class")).count()
        classes = findings.imbalance_findings(counts.withColumn("run_id", tag))
    return findings.finding_rows(
        findings.overfit_gap(board, board, best),
        findings.diversity(board),
        findings.importance_findings(result["importance"].withColumn("run_id", tag)),
        findings.size_findings(sizes),
        classes,
    )


def test_artifacts(run: train.Fitted, test: DataFrame) -> dict[str, DataFrame]:
    """Evaluation tables of the best model for its problem type; the rows are scored and written once."""
    scored = run.scored_table(test.where(col(run.label).isNotNull()))
    used = ["actual", "predicted", *[f"prob_{c}" for c in run.classes]] if run.classes else ["actual", "predicted", "residual"]
    scored = cut(scored.select(*[col(c) for c in used]))
    if not run.classes:
        return {
            "residual_stats": evaluate.residual_stats(scored),
            "residual_histogram": evaluate.residual_histogram(scored),
        }
    positive = run.classes[-1]
    table = evaluate.threshold_table(scored, "actual", f"prob_{positive}", positive)
    return {
        "confusion_matrix": evaluate.confusion_matrix(scored),
        "class_report": evaluate.class_report(scored),
        "roc_curve": evaluate.roc_curve(table),
        "roc_auc": evaluate.roc_auc(table),
        "pr_curve": evaluate.pr_curve(table),
        "average_precision": evaluate.average_precision(table),
    }


test_artifacts.__test__ = False


def train_report(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    drop: Sequence[str] = (),
    test_size: float = K.TEST_FRACTION,
    seed: int = K.SEED,
    profile_first: bool = False,
    **options,
) -> dict[str, object]:
    """Split, train, evaluate and analyse; ``profile_first`` also drops redundant features."""
    dropped = list(drop)
    if profile_first:
        columns = [c for c in df.columns if c not in key]
        corr = correlation.correlation_long(df.select(*[col(c) for c in columns]), label)
        advice = correlation.drop_recommendations(corr, label).select("feature").collect()
        dropped += [r["feature"] for r in advice if r["feature"] not in dropped]
    known = drop_columns(df, dropped, [label, *key]).where(col(label).isNotNull())
    stratify = train.problem_type(known, label, options.get("forced_type")) in ("binary", "multiclass")
    fit_on, test = splits.train_test_split(known, label, key, (), test_size, seed, stratify)
    result = train.train_and_evaluate(fit_on, test, label, key, seed=seed, **options)
    return {
        **result,
        "dropped": dropped,
        "findings": run_findings(result, fit_on, test),
        "top_models": top_leaderboard(result["leaderboard_test"]),
        "low_importance": train.low_importance(result["importance"]),
        "artifacts": test_artifacts(result["run"], test),
    }


def score_report(
    run: train.Fitted,
    data: DataFrame,
    fit_on: DataFrame | None = None,
    key: Sequence[str] = (),
    min_confidence: float | None = None,
    decision_threshold: float | None = None,
) -> dict[str, DataFrame]:
    """Scored rows with their summaries, and drift against the training table when it is given."""
    scored = run.score(data, None, decision_threshold, min_confidence)
    name = f"{run.label}_predicted"
    out = {"predictions": scored, "summary": train.scoring_summary(run, data)}
    if run.classes:
        out["distribution"] = evaluate.prediction_distribution(scored, name)
        out["probability_stats"] = evaluate.probability_stats(scored)
        if run.label in data.columns:
            known = scored.where(col(run.label).isNotNull())
            out["confusion_matrix"] = evaluate.confusion_matrix(known, run.label, name)
            out["class_report"] = evaluate.class_report(known, run.label, name)
    else:
        out["prediction_stats"] = evaluate.prediction_stats(scored, name, run.label)
        if run.label in data.columns:
            out["predictions"] = scored.withColumn("residual", col(run.label) - col(name))
    if fit_on is not None:
        out["drift"] = drift.detect_drift(fit_on, data, run.label, key)
    return out


def engineer_and_save(
    df: DataFrame, spec: dict, path: str, label: str | None = None, fmt: str = "parquet", out_of_range: str | None = "nan"
) -> features.Report:
    """Apply a transform spec and write ``<path>/data`` and, as one JSON row, ``<path>/spec``: what was asked for and done.

    A table given as ``interact_top_k`` importance is named by its columns, since only plain values are JSON.
    """
    out, report = features.apply_transformations(df, spec, label, out_of_range)
    write_table(out, f"{path}/data", fmt=fmt)
    plain = json.dumps(spec, sort_keys=True, default=lambda v: getattr(v, "columns", str(v)))
    row = [(plain, label, report.new_features, report.dropped_features, report.warnings)]
    schema = "spec string, label string, new_features array<string>, dropped_features array<string>, warnings array<string>"
    write_report(df.sparkSession.createDataFrame(row, schema).coalesce(1), f"{path}/spec")
    return report


def explanation_tables(shap: DataFrame, key: Sequence[str], features: Sequence[str]) -> dict[str, DataFrame]:
    """Wide values, summary, top features per row, and one row of metadata."""
    # every row repeats the base value, so a maximum finds it; one pass over the values serves the whole metadata row
    facts = explain.shap_summary(shap, F.max("base_value").alias("_base"), F.count(F.lit(1)).alias("_rows"))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "feature"))))
    first = F.sum(F.when(F.col("feature") == features[0], F.col("_rows")))
    return {
        "values": explain.shap_wide(shap, key, features),
        "summary": facts.drop("_base", "_rows"),
        "per_row": explain.shap_top_features(shap, key),
        "metadata": facts.agg(
            F.max("_base").alias("base_value"),
            F.coalesce(first, F.lit(0)).alias("n_rows"),
            F.transform(top, lambda x: x["feature"]).alias("top_features"),
            F.count(F.lit(1)).alias("n_features"),
        ),
    }
