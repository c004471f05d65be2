"""Single-feature leakage scores from histograms.

Each feature is cut into at most ``MAX_BINS`` bins. One aggregation gives, per feature,
fold and bin, the label statistics a small tree needs, so all rows take part and the data
is read once whatever the number of features. The trees themselves see only those
statistics: at most ``folds * MAX_BINS`` rows per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import constants as K
from tablewright.functions.schema import (
    col,
    feature_columns,
    is_classification,
    label_values,
    nan_to_null,
    require_columns,
)
from tablewright.functions.stats import to_micros
from tablewright.operators.splits import assign_folds
from tablewright.plans.binning import binned_long

MAX_BINS = 256
TEXT_SAMPLE = 10_000
SAMPLE_SLOTS = 1_000_000_007


def _numeric(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return to_micros(col(c)).cast("double")
    return col(c).cast("double")


def _numeric_stats(df: DataFrame, names: Sequence[str], stats: Column) -> DataFrame:
    points = [i / MAX_BINS for i in range(1, MAX_BINS)]
    values = {c: _numeric(df, c) for c in names}
    found = df.agg(
        *[F.percentile_approx(v, points, 10_000).alias(f"n{i}") for i, v in enumerate(values.values())]
    ).first()
    edges = {c: sorted(set(found[i] or [])) for i, c in enumerate(names)}
    long = binned_long(df, values, edges, ["_fold", "_y"])
    return long.groupBy("feature", F.col("_fold").alias("fold"), "bin").agg(stats.alias("stats"))


def _text_stats(df: DataFrame, names: Sequence[str], stats: Column, width: int) -> DataFrame:
    """Values are codes in sort order; more than ``MAX_BINS`` of them share range bins."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("value")) for c in names])
    per_value = (
        df.select("_fold", "_y", F.inline(cells))
        .where("value IS NOT NULL")
        .groupBy("feature", F.col("_fold").alias("fold"), "value")
        .agg(stats.alias("stats"))
    )
    sizes = df.agg(*[F.approx_count_distinct(col(c)) for c in names]).first()
    share = F.lit(0.0)
    for c, n in zip(names, sizes, strict=True):
        share = F.when(F.col("feature") == c, F.lit(min(1.0, TEXT_SAMPLE / max(1, n)))).otherwise(share)
    # about TEXT_SAMPLE values per feature place the edges; every row is still binned
    picked = F.pmod(F.xxhash64("value"), F.lit(SAMPLE_SLOTS)) < share * SAMPLE_SLOTS
    sample = per_value.where(picked).select("feature", "value").distinct().collect()
    number = F.lit(0)
    for c in names:
        known = sorted(r["value"] for r in sample if r["feature"] == c)
        if len(known) > MAX_BINS:
            known = [known[len(known) * i // MAX_BINS] for i in range(MAX_BINS)]
        edges = F.array(*[F.lit(v) for v in known]) if known else F.array().cast("array<string>")
        passed = F.size(F.filter(edges, lambda e: e <= F.col("value")))
        number = F.when(F.col("feature") == c, passed).otherwise(number)
    sums = F.array(*[F.sum(F.col("stats")[i]) for i in range(width)])
    return per_value.groupBy("feature", "fold", number.cast("int").alias("bin")).agg(sums.alias("stats"))


def _cost(s: np.ndarray, classes: bool) -> np.ndarray:
    """Impurity times rows: Gini for class counts, squared error for (n, sum, sum of squares)."""
    if classes:
        n = s.sum(axis=-1)
        return n - np.divide((s * s).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)
    n = s[..., 0]
    return s[..., 2] - np.divide(s[..., 1] ** 2, n, out=np.zeros_like(n), where=n > 0)


def fit_histogram_tree(train: np.ndarray, depth: int, classes: bool) -> np.ndarray:
    """Prediction per bin of a greedy tree over ordered bins (class index or mean)."""
    total = train.sum(axis=0)
    if classes:
        leaf = np.full(len(train), float(total.argmax()))
    else:
        leaf = np.full(len(train), total[1] / total[0] if total[0] else 0.0)
    filled = np.flatnonzero(train.sum(axis=1) if classes else train[:, 0])
    if depth == 0 or len(filled) < 2 or _cost(total, classes) <= 1e-12:
        return leaf
    left = train[filled].cumsum(axis=0)[:-1]
    costs = _cost(left, classes) + _cost(total - left, classes)
    i = int(costs.argmin())
    at = (filled[i] + filled[i + 1]) // 2 + 1  # an unseen bin goes to the nearer side
    return np.concatenate(
        [fit_histogram_tree(train[:at], depth - 1, classes), fit_histogram_tree(train[at:], depth - 1, classes)]
    )


def fold_score(predicted: np.ndarray, held_out: np.ndarray, classes: bool) -> float:
    """Balanced accuracy over the classes present, or R2."""
    if classes:
        support = held_out.sum(axis=0)
        hits = np.array([held_out[predicted == k, k].sum() for k in range(held_out.shape[1])])
        return float((hits[support > 0] / support[support > 0]).mean())
    n, sums, squares = held_out.T
    error = (squares - 2 * predicted * sums + predicted**2 * n).sum()
    spread = squares.sum() - sums.sum() ** 2 / n.sum()
    if spread <= 1e-12:
        return 1.0 if error <= 1e-12 else 0.0
    return float(1 - error / spread)


def _scorer(folds: int, depth: int, min_rows: int, classes: bool):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        width = len(pdf["stats"].iloc[0])
        table = np.zeros((folds, int(pdf["bin"].max()) + 1, width))
        for fold, b, s in zip(pdf["fold"], pdf["bin"], pdf["stats"], strict=True):
            table[fold, b] += np.asarray(s, dtype=float)
        per_fold = table.sum(axis=(1, 2)) if classes else table[:, :, 0].sum(axis=1)
        rows = int(per_fold.sum())
        out = {"feature": [pdf["feature"].iloc[0]], "rows": [rows], "score": [None]}
        if rows >= min_rows and (per_fold > 0).all():
            everything = table.sum(axis=0)
            scores = [
                fold_score(fit_histogram_tree(everything - table[f], depth, classes), table[f], classes)
                for f in range(folds)
            ]
            out["score"] = [round(float(np.mean(scores)), 4)]
        return pd.DataFrame(out)

    return score


def leakage_scores(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    features: Sequence[str] | None = None,
    seed: int = K.SEED,
    folds: int = K.LEAKAGE_FOLDS,
    depth: int = K.LEAKAGE_TREE_DEPTH,
) -> DataFrame:
    """``feature, rows, score`` (cross-validated, all rows), best first.

    Rows without a label are dropped, rows without a value are dropped per feature, and a
    feature with fewer than ten rows left is skipped.
    """
    df = nan_to_null(df)
    require_columns(df, [label, *key], "leakage_scores")
    names = list(features) if features is not None else feature_columns(df, label, key)
    known = df.where(col(label).isNotNull())
    classes = is_classification(known, label, K.CLASSIFICATION_MAX_CLASSES)
    folded = assign_folds(known, key, folds, label if classes else None, seed, column="_fold")
    if classes:
        values = sorted(label_values(known, label, K.CLASSIFICATION_MAX_CLASSES + 1))
        y = col(label)
        stats = F.array(*[F.count_if(F.col("_y") == F.lit(v)).cast("double") for v in values])
        width = len(values)
    else:
        # centred, so that sums of squares keep their digits
        y = col(label).cast("double") - F.lit(known.agg(F.avg(col(label).cast("double"))).first()[0])
        stats = F.array(F.count("_y").cast("double"), F.sum("_y"), F.sum(F.col("_y") * F.col("_y")))
        width = 3
    frame = folded.withColumn("_y", y)
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    other = [c for c in names if c not in text]
    parts = []
    if other:
        parts.append(_numeric_stats(frame, other, stats))
    if text:
        parts.append(_text_stats(frame, text, stats, width))
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    scorer = _scorer(folds, depth, K.LEAKAGE_MIN_ROWS, classes)
    scored = cells.groupBy("feature").applyInPandas(scorer, "feature string, rows bigint, score double")
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), "feature")


def leakage_verdicts(scores: DataFrame, threshold: float = K.LEAKAGE_THRESHOLD) -> DataFrame:
    """Add ``suspected`` and a graded ``reason`` to the score table."""
    s = F.col("score")
    reason = (
        F.when(s < threshold, F.lit(None).cast("string"))
        .when(s >= 0.999, "perfect single-feature predictor: a copy or a value known only afterwards")
        .when(s >= 0.98, "near-perfect score: probably derived from the target")
        .otherwise("score above the threshold: check how the feature is computed")
    )
    return scores.withColumns({"suspected": s >= threshold, "reason": reason})


def leakage_hints(verdicts: DataFrame, threshold: float = K.LEAKAGE_THRESHOLD) -> DataFrame:
    """One row: suspects, the drop list, and the top clean score when it is above 0.85."""
    best = F.max(F.struct("score", "feature"))
    return verdicts.agg(
        F.count_if("suspected").alias("suspects"),
        F.sort_array(F.collect_list(F.when(F.col("suspected"), F.col("feature")))).alias("drop_list"),
        F.when(
            (F.count_if("suspected") == 0) & (best["score"] > 0.85), best["feature"]
        ).alias("watch_feature"),
    )
