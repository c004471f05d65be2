"""Rule-based findings and pruning advice over the result tables of many runs at once.

Tables are keyed by ``run_id``. Per-run choices are aggregates (``max_by``) or top-k ranks,
which Spark trims before the shuffle, so one run holding most of the rows does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.plans.lineage import cut

# Substrings that name a model family, tried in this order.
FAMILY_NAMES = (
    "weightedensemble",
    "catboost",
    "lightgbm",
    "xgboost",
    "randomforest",
    "extratrees",
    "knn",
    "neuralnet",
    "fastai",
    "tabular",
    "linear",
)


def model_family(model: Column) -> Column:
    """First family name contained in the lower-cased model name, else the name itself."""
    name = F.lower(model)
    hits = [F.when(name.contains(f), F.lit(f)) for f in FAMILY_NAMES]
    return F.coalesce(*hits, model)


def best_per_run(leaderboard: DataFrame, score: str = "score_val") -> DataFrame:
    """``run_id, best_model``: highest score, first name on ties."""
    best = F.min(F.struct((-F.col(score)).alias("s"), "model"))
    return leaderboard.where(F.col(score).isNotNull()).groupBy("run_id").agg(best["model"].alias("best_model"))


def overfit_gap(val: DataFrame, test: DataFrame, best: DataFrame) -> DataFrame:
    """Validation against test score of each run's best model, with the gap graded."""
    v = val.select("run_id", "model", "score_val")
    t = test.select("run_id", "model", "score_test")
    picked = best.select("run_id", F.col("best_model").alias("model"))
    gap = F.abs(F.col("score_val") - F.col("score_test"))
    share = F.coalesce(F.try_divide(gap, F.abs("score_val")) * 100, F.lit(0.0))
    return (
        picked.join(v, ["run_id", "model"])
        .join(t, ["run_id", "model"])
        .withColumns({"gap": gap, "gap_pct": share})
        .withColumn(
            "severity",
            F.when(F.col("gap_pct") > K.OVERFIT_SEVERE_PCT, "severe")
            .when(F.col("gap_pct") > K.OVERFIT_MODERATE_PCT, "moderate")
            .otherwise("none"),
        )
    )


def diversity(leaderboard: DataFrame) -> DataFrame:
    """``run_id, n_models, few_models, top_families, same_family``: best three by test score."""
    counts = leaderboard.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_models"))
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("score_test"), "model")
    top = (
        leaderboard.withColumn("k", F.row_number().over(order))
        .where("k <= 3")
        .groupBy("run_id")
        .agg(
            F.count_distinct(model_family(F.col("model"))).alias("top_families"),
            F.min(model_family(F.col("model"))).alias("family"),
        )
    )
    one = (F.col("top_families") == 1) & (F.col("n_models") > 3)
    return counts.join(top, "run_id").select(
        "run_id",
        "n_models",
        (F.col("n_models") < K.MIN_MODELS).alias("few_models"),
        "top_families",
        one.alias("same_family"),
        F.when(one, F.col("family")).alias("family"),
    )


def importance_findings(importance: DataFrame) -> DataFrame:
    """``run_id, low, harmful``: sorted names of near-zero and negative features."""
    low = F.when(F.col("importance") <= K.LOW_IMPORTANCE, F.col("feature"))
    bad = F.when(F.col("importance") < 0, F.col("feature"))
    return importance.groupBy("run_id").agg(
        F.sort_array(F.collect_list(low)).alias("low"), F.sort_array(F.collect_list(bad)).alias("harmful")
    )


def size_findings(runs: DataFrame) -> DataFrame:
    """From ``run_id, n_train, n_test, n_features``: few rows per feature, small test set."""
    return runs.select(
        "run_id",
        (F.col("n_train") < F.col("n_features") * K.MIN_ROWS_PER_FEATURE).alias("few_rows_per_feature"),
        F.round(F.try_divide("n_train", "n_features"), 1).alias("rows_per_feature"),
        (F.col("n_test") < K.SMALL_TEST_ROWS).alias("small_test"),
    )


def imbalance_findings(classes: DataFrame) -> DataFrame:
    """From ``run_id, class, count``: majority to minority ratio, graded."""
    ratio = F.try_divide(F.max("count"), F.min("count"))
    return classes.groupBy("run_id").agg(F.round(ratio, 4).alias("ratio")).withColumn(
        "severity",
        F.when(F.col("ratio") > K.IMBALANCE_SEVERE, "severe")
        .when(F.col("ratio") > K.IMBALANCE_MODERATE, "moderate")
        .otherwise("none"),
    )


def finding_rows(
    gaps: DataFrame,
    spread: DataFrame,
    importance: DataFrame,
    sizes: DataFrame,
    classes: DataFrame | None = None,
) -> DataFrame:
    """All rules as ``run_id, code, severity, message``."""

    def rows(df: DataFrame, when: Column, code: str, severity: Column | str, message: Column) -> DataFrame:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return df.where(when).select(
            "run_id", F.lit(code).alias("code"), level.alias("severity"), message.alias("message")
        )

    parts = [
        rows(
            gaps, F.col("severity") != "none", "overfit_gap", F.col("severity"),
            F.format_string("validation/test gap of '%s' is %.1f%%", "model", "gap_pct"),
        ),
        rows(spread, F.col("few_models"), "few_models", "moderate", F.format_string("only %d models", "n_models")),
        rows(
            spread, F.col("same_family"), "same_family", "moderate",
            F.format_string("the top three models are all '%s'", "family"),
        ),
        rows(
            importance, F.size("low") > 0, "low_importance", "moderate",
            F.format_string("%d features have near-zero importance: consider dropping them", F.size("low")),
        ),
        rows(
            importance, F.size("harmful") > 0, "harmful_features", "severe",
            F.concat(F.lit("drop features that hurt: "), F.array_join("harmful", ", ")),
        ),
        rows(
            sizes, F.col("few_rows_per_feature"), "few_rows_per_feature", "moderate",
            F.format_string("%.1f rows per feature", "rows_per_feature"),
        ),
        rows(sizes, F.col("small_test"), "small_test", "moderate", F.lit("the test set is small: scores are unreliable")),
    ]
    if classes is not None:
        parts.append(
            rows(
                classes, F.col("severity") != "none", "class_imbalance", F.col("severity"),
                F.format_string("class ratio %.1f:1", "ratio"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def findings_table(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run: codes and messages, or the all-clear. A run has at most one row per rule."""
    entry = F.sort_array(F.collect_list(F.struct("code", "severity", "message")))
    grouped = rows.groupBy("run_id").agg(entry.alias("findings"))
    clear = F.array(
        F.struct(
            F.lit("clear").alias("code"), F.lit("none").alias("severity"), F.lit("no major issues").alias("message")
        )
    )
    return runs.select("run_id").join(grouped, "run_id", "left").withColumn(
        "findings", F.coalesce("findings", clear)
    )


def dependency_closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``run_id, model``: the start models and everything they are built from.

    ``edges`` is ``run_id, parent, child``. The jumps double: a round adds what is one jump of 1, 2, 4, ... levels away
    from what is known, so a chain of n levels takes about log2(n) rounds, each written to the checkpoint folder. It
    ends when no child of a known model is missing, which also ends cycles. With ``max_depth`` a longer shortest path
    is an error.
    """
    links = cut(edges.select("run_id", F.col("parent").alias("model"), "child").distinct())
    known = cut(start.select("run_id", "model").distinct().withColumn("_depth", F.lit(0)))
    jump, levels = links, 1
    while True:
        reached = known.join(jump, ["run_id", "model"]).select(
            "run_id", F.col("child").alias("model"), (F.col("_depth") + levels).alias("_depth")
        )
        known = cut(known.unionByName(reached).groupBy("run_id", "model").agg(F.min("_depth").alias("_depth")))
        children = links.join(known, ["run_id", "model"], "left_semi").select("run_id", F.col("child").alias("model"))
        if children.join(known, ["run_id", "model"], "left_anti").isEmpty():
            break
        onwards = jump.select("run_id", F.col("model").alias("_via"), F.col("child").alias("_end"))
        twice = jump.withColumnRenamed("child", "_via").join(onwards, ["run_id", "_via"])
        jump, levels = cut(twice.select("run_id", "model", F.col("_end").alias("child")).distinct()), levels * 2
    if max_depth is not None and not known.where(F.col("_depth") > max_depth).isEmpty():
        raise ValueError(f"dependencies are deeper than {max_depth} levels")
    return known.drop("_depth")


def ensemble_analysis(leaderboard: DataFrame, edges: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Leaderboard with ``is_best`` and ``contributes_to_best``."""
    best = best_per_run(leaderboard) if best is None else best
    closure = dependency_closure(edges, best.select("run_id", F.col("best_model").alias("model")))
    marked = leaderboard.join(closure.withColumn("_c", F.lit(True)), ["run_id", "model"], "left")
    named = marked.join(best, "run_id", "left")
    return named.withColumns(
        {
            "is_best": F.coalesce(F.col("model") == F.col("best_model"), F.lit(False)),
            "contributes_to_best": F.coalesce("_c", F.lit(False)),
        }
    ).drop("_c", "best_model")


def prune_advice(analysis: DataFrame, gap_pct: float = K.PRUNE_GAP_PCT) -> DataFrame:
    """``run_id, model, gap_pct`` of models neither best nor contributing and clearly worse."""
    top = analysis.where("is_best").groupBy("run_id").agg(F.max("score_val").alias("_best"))
    gap = F.abs(F.col("_best") - F.col("score_val")) / F.abs("_best") * 100
    return (
        analysis.join(top, "run_id")
        .where(~F.col("is_best") & ~F.col("contributes_to_best"))
        .withColumn("gap_pct", F.when(F.col("_best") != 0, gap).otherwise(0.0))
        .where(F.col("gap_pct") > gap_pct)
        .select("run_id", "model", "gap_pct")
    )


def apply_pruning(analysis: DataFrame, advice: DataFrame, dry_run: bool = False) -> DataFrame:
    """Models left after pruning; all of them on a dry run."""
    return analysis if dry_run else analysis.join(advice, ["run_id", "model"], "left_anti")


def renormalised_weights(weights: DataFrame, kept: DataFrame) -> DataFrame:
    """Blend weights of the kept models, summing to one per run again."""
    left = weights.join(kept.select("run_id", "model"), ["run_id", "model"], "left_semi")
    total = left.groupBy("run_id").agg(F.sum("weight").alias("_t"))
    return left.join(total, "run_id").select("run_id", "model", F.try_divide("weight", "_t").alias("weight"))


def pruning_report(analysis: DataFrame, advice: DataFrame) -> DataFrame:
    """Totals per run."""
    marked = analysis.join(
        advice.select("run_id", "model", F.lit(1).alias("_p")), ["run_id", "model"], "left"
    )
    return marked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count("_p").alias("pruned_count"),
        (F.count(F.lit(1)) - F.count("_p")).alias("remaining_count"),
    )
