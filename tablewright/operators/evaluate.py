"""Evaluation of scored tables; no operator here needs the model itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import constants as K
from tablewright.functions.schema import col
from tablewright.functions.stats import pct
from tablewright.operators.profile import numeric_profile
from tablewright.plans.selection import exact_quantiles
from tablewright.plans.totals import ROWS_PER_BUCKET, bucket_edges, running_totals, with_bucket

MAX_CLASSES = 10_000


def class_key(c: Column, dtype: T.DataType) -> Column:
    """Text form of a class: ``1.0`` reads as ``1`` and booleans as ``True`` / ``False``."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def typed_key(df: DataFrame, name: str) -> Column:
    return class_key(col(name), df.schema[name].dataType)


def pair_counts(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``actual, predicted, n`` as text keys: the only pass over the rows that E1, E2 need."""
    return scored.groupBy(
        typed_key(scored, actual).alias("actual"), typed_key(scored, predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Long ``actual, predicted, n`` over the classes seen as actual, zeros included."""
    counts = pair_counts(scored, actual, predicted)
    labels = [
        r["actual"]
        for r in counts.where("actual IS NOT NULL").select("actual").distinct().limit(MAX_CLASSES + 1).collect()
    ]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    per_class = counts.where("actual IS NOT NULL").groupBy("actual").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("predicted").isNotNull(), F.struct("predicted", "n")))).alias("m")
    )
    cells = per_class.select(
        "actual", "m", F.explode(F.array(*[F.lit(x) for x in sorted(labels)])).alias("predicted")
    )
    return cells.select(
        "actual", "predicted", F.coalesce(F.try_element_at("m", F.col("predicted")), F.lit(0)).alias("n")
    )


def confusion_wide(matrix: DataFrame) -> DataFrame:
    """One column per predicted class, for writing out."""
    return matrix.groupBy("actual").pivot("predicted").agg(F.first("n")).orderBy("actual")


def _class_tallies(counts: DataFrame, *extra: str, by: Sequence[str] = ()) -> DataFrame:
    """``class, support, npred, tp`` per class seen on either side; ``extra`` sums go to the actual class."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(none)

    def side(c: str, support: Column, npred: Column, tp: Column, keep: bool) -> Column:
        more = [(F.col(e) if keep else F.lit(None).cast("double")).alias(e) for e in extra]
        return F.struct(
            F.col(c).alias("class"), support.alias("s"), npred.alias("p"), tp.alias("tp"), *more
        )

    both = F.array(
        side("actual", F.col("n"), none, hit, True), side("predicted", none, F.col("n"), none, False)
    )
    return (
        counts.select(*by, F.explode(both).alias("x"))
        .groupBy(*by, "x.class")
        .agg(
            F.sum("x.s").alias("support"),
            F.sum("x.p").alias("npred"),
            F.sum("x.tp").alias("tp"),
            *[F.sum(f"x.{e}").alias(e) for e in extra],
        )
    )


def class_report(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """``class, precision, recall, f1, support`` per class, then accuracy, macro and weighted rows."""
    counts = pair_counts(scored, actual, predicted)
    tallies = _class_tallies(counts)
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide("tp", "npred"), zero)
    r = F.coalesce(F.try_divide("tp", "support"), zero)
    per_class = tallies.select(
        "class",
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("npred") + F.col("support")), zero).alias("f1"),
        "support",
        "tp",
    )
    total = F.sum("support")
    accuracy = F.sum("tp") / total

    def row(name: str, *cells: Column) -> Column:
        keys = ("precision", "recall", "f1", "support")
        return F.struct(F.lit(name).alias("class"), *[c.alias(k) for c, k in zip(cells, keys, strict=True)])

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    summary = per_class.agg(
        F.array(
            row("accuracy", accuracy, accuracy, accuracy, total),
            row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1"), total),
            row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), total),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(summary)


def positive_class(scored: DataFrame, actual: str = "actual"):
    """The highest class in sort order."""
    return scored.agg(F.max(col(actual))).first()[0]


def _score_groups(scored: DataFrame, actual: str, score: str, pos_label, rows: Column | None = None) -> DataFrame:
    hit = col(actual) == F.lit(pos_label)
    each = F.lit(1) if rows is None else rows
    return (
        scored.where(col(score).isNotNull() & col(actual).isNotNull())
        .groupBy(col(score).cast("double").alias("threshold"))
        .agg(F.sum(F.when(hit, each).otherwise(0)).alias("pos"), F.sum(F.when(hit, 0).otherwise(each)).alias("neg"))
    )


def score_edges(scored: DataFrame, score: str) -> list[float]:
    """Edges of score buckets; none while one task can order every distinct score."""
    known = scored.where(col(score).isNotNull())
    return bucket_edges(known, score) if known.count() > ROWS_PER_BUCKET else []


def threshold_table(
    scored: DataFrame, actual: str, score: str, pos_label=None, edges: Sequence[float] | None = None, rows: Column | None = None
) -> DataFrame:
    """Per distinct score, highest first: ``pos, neg``, cumulative ``tp, fp`` and totals ``p, n``.

    Other classes count as negative (one against the rest). A row counts as ``rows`` rows, one by default.
    """
    known = scored.where(col(score).isNotNull() & col(actual).isNotNull())
    tally = known.groupBy(col(actual).alias("c")).agg(F.sum(F.lit(1) if rows is None else rows).alias("n"))
    sizes = {r["c"]: r["n"] for r in tally.limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if pos_label is None:
        pos_label = max(sizes) if sizes else positive_class(scored, actual)
    p = sizes.get(pos_label, 0)
    n = sum(sizes.values()) - p
    if edges is None:
        edges = bucket_edges(known, score) if p + n > ROWS_PER_BUCKET else []
    groups = _score_groups(scored, actual, score, pos_label, rows)
    return running_totals(groups, "threshold", ["pos", "neg"], edges, descending=True).select(
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        "next_pos",
        "next_neg",
        F.lit(p).cast("bigint").alias("p"),
        F.lit(n).cast("bigint").alias("n"),
    )


def roc_curve(table: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """``fpr, tpr, threshold`` from :func:`threshold_table`, with the (0, 0) start at infinity.

    Points in the middle of a straight stretch (same step before and after) are left out
    unless ``drop_intermediate`` is false.
    """
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bend = (
        F.col("next_pos").isNull()
        | (F.col("pos") != F.col("next_pos"))
        | (F.col("neg") != F.col("next_neg"))
    )
    point = F.struct(
        F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"), F.col("threshold").alias("threshold")
    )
    start = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    kept = table.where(first | bend) if drop_intermediate else table
    # the first row brings the start point along, so the curve is computed once
    return kept.select(F.inline(F.when(first, F.array(start, point)).otherwise(F.array(point))))


def roc_auc(table: DataFrame) -> DataFrame:
    """One row: area under the ROC curve, ties counted half; NULL with a single class."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return table.agg(F.try_divide(area, F.max(F.col("p").cast("double") * F.col("n"))).alias("roc_auc"))


def roc_auc_by(
    scored: DataFrame, actual: str, score: str, pos_label, by: Sequence[str], edges: Sequence[float] = ()
) -> DataFrame:
    """``by, roc_auc``: the area of each group from one pass, ties counted half; NULL with a single class.

    Equal scores of a group become one row before anything is ordered. Score buckets (``edges``) rank their own rows;
    what a lower score gains from the buckets above it needs only their totals, at most one row per bucket and group.
    """
    hit = col(actual) == F.lit(pos_label)
    keys = [col(c) for c in by]
    groups = (
        scored.where(col(score).isNotNull() & col(actual).isNotNull())
        .groupBy(*keys, col(score).cast("double").alias("_score"))
        .agg(F.count_if(hit).alias("_pos"), F.count_if(~hit).alias("_neg"))
    )
    bucketed = with_bucket(groups, "_score", edges, "_bucket")
    above = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_score"))
    won = F.sum("_pos").over(above) - F.col("_pos") / 2.0
    sums = bucketed.withColumn("_area", F.col("_neg") * won).groupBy(*keys, "_bucket").agg(
        F.sum("_pos").cast("double").alias("_pos"), F.sum("_neg").cast("double").alias("_neg"), F.sum("_area").alias("_area")
    )
    before = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    total = sums.withColumn("_area", F.col("_area") + F.col("_neg") * F.coalesce(F.sum("_pos").over(before), F.lit(0.0)))
    both = F.sum("_pos") * F.sum("_neg")
    return total.groupBy(*keys).agg(F.try_divide(F.sum("_area"), both).alias("roc_auc"))


def pr_curve(table: DataFrame) -> DataFrame:
    """``precision, recall, threshold`` plus the closing point (1, 0) without a threshold."""
    curve = table.select(
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide("tp", "p"), F.lit(1.0)).alias("recall"),
        "threshold",
    )
    end = table.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return curve.unionByName(end)


def average_precision(table: DataFrame) -> DataFrame:
    step = F.try_divide("pos", "p") * F.try_divide("tp", F.col("tp") + F.col("fp"))
    return table.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def threshold_metrics(table: DataFrame) -> DataFrame:
    """Every cutoff metric at every distinct threshold (predict positive when score >= threshold)."""
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    fn, tn = p - tp, n - fp
    zero = F.lit(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), zero)

    return table.select(
        "threshold",
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, p + n).alias("accuracy"),
        ((ratio(tp, p) + ratio(tn, n)) / 2).alias("balanced_accuracy"),
        ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(p) * F.sqrt(n) * F.sqrt(tn + fn)).alias("mcc"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, p).alias("recall"),
    )


def calibrate_threshold(table: DataFrame, metric: str = "f1") -> DataFrame:
    """One row ``metric, threshold, score``: the best cutoff, the highest one on ties."""
    metrics = threshold_metrics(table)
    if metric not in metrics.columns or metric == "threshold":
        raise ValueError(f"'{metric}' is not one of {metrics.columns[1:]}")
    best = F.max(F.struct(F.round(metric, 10).alias("score"), "threshold"))
    return metrics.agg(best.alias("b")).select(
        F.lit(metric).alias("metric"), F.col("b.threshold").alias("threshold"), F.col("b.score").alias("score")
    )


def classification_scores(
    scored: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    prob_of_actual: Column | None = None,
    positive: str | None = None,
    by: Sequence[str] = (),
    rows: Column | None = None,
) -> DataFrame:
    """Accuracy, balanced accuracy, f1 macro / weighted, mcc and log loss: one row per ``by`` group.

    ``positive`` (a class as text) adds its ``f1``. The rows are read once and reduced to one
    line per class pair. A row counts as ``rows`` rows, one by default.
    """
    keyed = scored.select(
        *by,
        (F.lit(1) if rows is None else rows).alias("rows"),
        typed_key(scored, actual).alias("actual"),
        typed_key(scored, predicted).alias("predicted"),
        (prob_of_actual if prob_of_actual is not None else F.lit(None).cast("double")).alias("q"),
    )
    eps = 1e-15
    loss = -F.ln(F.least(F.greatest("q", F.lit(eps)), F.lit(1 - eps)))
    counts = keyed.groupBy(*by, "actual", "predicted").agg(
        F.sum("rows").alias("n"), F.sum(loss * F.col("rows")).alias("loss")
    )
    per_class = _class_tallies(counts, "loss", by=by).select(
        *by,
        "class",
        F.col("support").cast("double").alias("s"),
        F.col("npred").cast("double").alias("p"),
        F.col("tp").cast("double").alias("tp"),
        "loss",
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("s")), F.lit(0.0))
    n = F.sum("s")
    cov = F.sum("tp") * n - F.sum(F.col("s") * F.col("p"))
    spread = F.sqrt(n * n - F.sum(F.col("p") * F.col("p"))) * F.sqrt(n * n - F.sum(F.col("s") * F.col("s")))
    more = [F.max(F.when(F.col("class") == positive, f1)).alias("f1")] if positive is not None else []
    return per_class.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.try_divide("tp", "s")).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("s")) / n).alias("f1_weighted"),
        F.coalesce(F.try_divide(cov, spread), F.lit(0.0)).alias("mcc"),
        (F.sum("loss") / n).alias("log_loss"),
        *more,
    )


def r2_score(actual: Column, residual: Column) -> Column:
    total = F.var_pop(actual) * F.count(actual)
    return F.coalesce(F.lit(1.0) - F.try_divide(F.sum(residual * residual), total), F.lit(0.0))


def residual_stats(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: mean, median, sample std, min, max, MAE, RMSE and R2 of ``actual - predicted``."""
    rows = scored.select(
        col(actual).cast("double").alias("a"), (col(actual) - col(predicted)).cast("double").alias("r")
    ).where("r IS NOT NULL AND NOT isnan(r)")
    median = exact_quantiles(rows, ["r"], [0.5])["r"][0]
    r = F.col("r")
    return rows.agg(
        F.avg(r).alias("mean_residual"),
        F.lit(median).cast("double").alias("median_residual"),
        F.stddev_samp(r).alias("std_residual"),
        F.min(r).alias("min_residual"),
        F.max(r).alias("max_residual"),
        F.avg(F.abs(r)).alias("mean_absolute_error"),
        F.sqrt(F.avg(r * r)).alias("root_mean_squared_error"),
        r2_score(F.col("a"), r).alias("r2"),
    )


def residual_histogram(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted", bins: int = K.RESIDUAL_BINS
) -> DataFrame:
    """``bin, bin_left, bin_right, n``: equal widths over [min, max], last bin closed, empty bins kept."""
    rows = scored.select((col(actual) - col(predicted)).cast("double").alias("r")).where("r IS NOT NULL")
    lo, hi = rows.agg(F.min("r"), F.max("r")).first()
    if lo is None:
        raise ValueError("residual_histogram: no residuals")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins

    def left(i: Column) -> Column:
        return F.lit(lo) + i * F.lit(width)

    guess = F.least(F.floor((F.col("r") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    # floating point may put a value one bin off its printed edges
    fixed = (
        F.when(F.col("r") < left(guess), guess - 1)
        .when((guess < bins - 1) & (F.col("r") >= left(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = rows.groupBy(fixed.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        left(F.col("bin")).alias("bin_left"),
        left(F.col("bin") + 1).alias("bin_right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def probability_stats(scored: DataFrame) -> DataFrame:
    """Describe each ``prob_*`` column."""
    probs = [c for c in scored.columns if c.startswith("prob_")]
    stats = numeric_profile(scored, None, probs)
    return stats.select("feature", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def prediction_distribution(scored: DataFrame, predicted: str = "predicted") -> DataFrame:
    """``class, count, percentage``, most frequent first."""
    counts = scored.groupBy(typed_key(scored, predicted).alias("class")).count()
    rows = scored.count()
    return counts.withColumn("percentage", pct(F.col("count"), F.lit(rows))).orderBy(F.desc("count"), "class")


def prediction_stats(scored: DataFrame, predicted: str, label: str | None = None) -> DataFrame:
    """One row about the predictions, with error statistics when the truth is present."""
    median = exact_quantiles(scored, [predicted], [0.5])[predicted][0]
    p = col(predicted).cast("double")
    exprs = [
        F.avg(p).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(p).alias("std"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
    ]
    if label in scored.columns:
        r = col(label).cast("double") - p
        exprs += [
            F.avg(r).alias("mean_residual"),
            F.avg(F.abs(r)).alias("mean_absolute_error"),
            F.sqrt(F.avg(r * r)).alias("root_mean_squared_error"),
            r2_score(col(label).cast("double"), r).alias("r2"),
        ]
    return scored.agg(*exprs)
