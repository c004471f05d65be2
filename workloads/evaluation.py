"""Evaluation and error-inspection queries over formula-scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import errors, evaluate
from workloads.common import (
    BINARY_SQL,
    MULTI_SQL,
    REGRESSION_SQL,
    Registry,
    rounded,
    scored_binary,
    scored_multi,
    scored_regression,
    table,
)

R = Registry()


@R.add(f"""WITH s AS ({MULTI_SQL}), l AS (SELECT DISTINCT actual FROM s)
SELECT a.actual, p.actual AS predicted, count(s.actual)::BIGINT AS n FROM l a JOIN l p ON true
LEFT JOIN s ON s.actual = a.actual AND s.predicted = p.actual GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_multi(spark, sf_dir))


@R.add("""SELECT o_orderpriority AS actual, l AS predicted, count(*) FILTER (l = CASE WHEN o_orderstatus = 'P' THEN '0-NEW' ELSE '1-URGENT' END)::BIGINT AS n
FROM orders, (SELECT DISTINCT o_orderpriority AS l FROM orders) GROUP BY 1, 2""")
def confusion_unseen_class(spark, sf_dir):
    """Predictions of a class that is never actual stay out of the matrix."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("actual"),
        F.when(F.col("o_orderstatus") == "P", "0-NEW").otherwise("1-URGENT").alias("predicted"),
    )
    return evaluate.confusion_matrix(df)


def report_sql(source):
    return f"""WITH s AS ({source}), t AS (SELECT count(*) AS n, count(*) FILTER (actual = predicted) AS hit FROM s),
c AS (SELECT DISTINCT x AS class FROM (SELECT actual::VARCHAR AS x FROM s UNION ALL SELECT predicted::VARCHAR FROM s)),
k AS (SELECT class, (SELECT count(*) FROM s WHERE actual::VARCHAR = class) AS support,
   (SELECT count(*) FROM s WHERE predicted::VARCHAR = class) AS npred,
   (SELECT count(*) FROM s WHERE actual::VARCHAR = class AND predicted::VARCHAR = class) AS tp FROM c),
m AS (SELECT class, coalesce(tp / nullif(npred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
   coalesce(2 * tp / nullif(npred + support, 0), 0) AS f1, support FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM m
UNION ALL SELECT 'accuracy', round(hit / n, 6), round(hit / n, 6), round(hit / n, 6), n FROM t
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
   round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m"""


@R.add(report_sql(MULTI_SQL))
def class_report(spark, sf_dir):
    return rounded(evaluate.class_report(scored_multi(spark, sf_dir)), 6)


@R.add(report_sql(BINARY_SQL))
def class_report_binary(spark, sf_dir):
    return rounded(evaluate.class_report(scored_binary(spark, sf_dir)), 6)


TABLE_SQL = f"""(WITH s AS ({BINARY_SQL}), g AS (SELECT score AS threshold, count(*) FILTER (actual = 1) AS pos,
  count(*) FILTER (actual = 0) AS neg FROM s GROUP BY 1)
SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS i FROM g WINDOW w AS (ORDER BY threshold DESC))"""


def thresholds(spark, sf_dir):
    return evaluate.threshold_table(scored_binary(spark, sf_dir), "actual", "score")


@R.add(f"""SELECT fp / n AS fpr, tp / p AS tpr, threshold FROM {TABLE_SQL}
WHERE i = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg UNION ALL SELECT 0, 0, 'infinity'::DOUBLE""")
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(thresholds(spark, sf_dir))


@R.add(f"SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)), 8) AS roc_auc FROM {TABLE_SQL}")
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(thresholds(spark, sf_dir)), 8)


@R.add(f"""SELECT tp / (tp + fp) AS precision, tp / p AS recall, threshold FROM {TABLE_SQL}
UNION ALL SELECT 1, 0, NULL""")
def pr_curve(spark, sf_dir):
    return evaluate.pr_curve(thresholds(spark, sf_dir))


@R.add(f"SELECT round(sum(pos / p * tp / (tp + fp)), 8) AS average_precision FROM {TABLE_SQL}")
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(thresholds(spark, sf_dir)), 8)


@R.add(f"""WITH s AS ({MULTI_SQL}), g AS (SELECT prob_R AS t, count(*) FILTER (actual = 'R') AS pos, count(*) FILTER (actual <> 'R') AS neg
  FROM s GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)), 8) AS roc_auc FROM w""")
def roc_auc_multiclass(spark, sf_dir):
    """One against the rest for the highest class."""
    return rounded(evaluate.roc_auc(evaluate.threshold_table(scored_multi(spark, sf_dir), "actual", "prob_R")), 8)


def calibrated_sql(metric, formula):
    return f"""SELECT '{metric}' AS metric, threshold, score FROM (SELECT threshold, round({formula}, 8) AS score,
  round({formula}, 10) AS fine FROM {TABLE_SQL}) ORDER BY fine DESC, threshold DESC LIMIT 1"""


@R.add(calibrated_sql("f1", "2 * tp / (2 * tp + fp + (p - tp))"))
def calibrate_f1(spark, sf_dir):
    return rounded(evaluate.calibrate_threshold(thresholds(spark, sf_dir), "f1"), 8, ["score"])


@R.add(calibrated_sql("balanced_accuracy", "(tp / p + (n - fp) / n) / 2"))
def calibrate_balanced(spark, sf_dir):
    return rounded(evaluate.calibrate_threshold(thresholds(spark, sf_dir), "balanced_accuracy"), 8, ["score"])


@R.add(calibrated_sql("mcc", "coalesce((tp * (n - fp) - fp * (p - tp)) / nullif(sqrt(tp + fp) * sqrt(p) * sqrt(n) * sqrt(n - fp + p - tp), 0), 0)"))
def calibrate_mcc(spark, sf_dir):
    return rounded(evaluate.calibrate_threshold(thresholds(spark, sf_dir), "mcc"), 8, ["score"])


@R.add(f"""WITH s AS ({MULTI_SQL}), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (actual = predicted) AS hit,
  avg(-ln(CASE actual WHEN 'A' THEN prob_A WHEN 'N' THEN prob_N ELSE prob_R END)) AS loss FROM s),
k AS (SELECT c, (SELECT count(*) FROM s WHERE actual = c)::DOUBLE AS s, (SELECT count(*) FROM s WHERE predicted = c)::DOUBLE AS p,
  (SELECT count(*) FROM s WHERE actual = c AND predicted = c)::DOUBLE AS tp FROM (SELECT DISTINCT actual AS c FROM s)),
a AS (SELECT avg(tp / s) AS bal, avg(2 * tp / (p + s)) AS macro, sum(2 * tp / (p + s) * s) / sum(s) AS weighted,
  sum(s * p) AS sp, sum(p * p) AS pp, sum(s * s) AS ss FROM k)
SELECT round(hit / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(macro, 6) AS f1_macro, round(weighted, 6) AS f1_weighted,
  round((hit * n - sp) / (sqrt(n * n - pp) * sqrt(n * n - ss)), 6) AS mcc, round(loss, 6) AS log_loss FROM n, a""")
def classification_scores(spark, sf_dir):
    df = scored_multi(spark, sf_dir)
    prob = F.when(F.col("actual") == "A", F.col("prob_A")).when(F.col("actual") == "N", F.col("prob_N")).otherwise(F.col("prob_R"))
    return rounded(evaluate.classification_scores(df, prob_of_actual=prob), 6)


@R.add(f"""SELECT round(avg(residual), 3) AS mean_residual, round(quantile_cont(residual, 0.5), 3) AS median_residual,
  round(stddev_samp(residual), 3) AS std_residual, round(min(residual), 3) AS min_residual, round(max(residual), 3) AS max_residual,
  round(avg(abs(residual)), 3) AS mean_absolute_error, round(sqrt(avg(residual * residual)), 3) AS root_mean_squared_error,
  round(1 - sum(residual * residual) / (var_pop(actual) * count(*)), 6) AS r2 FROM ({REGRESSION_SQL})""")
def residual_stats(spark, sf_dir):
    out = evaluate.residual_stats(scored_regression(spark, sf_dir))
    return rounded(rounded(out, 3, [c for c in out.columns if c != "r2"]), 6, ["r2"])


@R.add(f"""WITH s AS ({REGRESSION_SQL}), e AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50 AS w FROM s),
b AS (SELECT i::INT AS bin, lo + i * w AS l, lo + (i + 1) * w AS r FROM e, range(50) t(i))
SELECT bin, round(l, 3) AS bin_left, round(r, 3) AS bin_right,
  (SELECT count(*) FROM s WHERE residual >= l AND (residual < r OR bin = 49))::BIGINT AS n FROM b""")
def residual_hist(spark, sf_dir):
    return rounded(evaluate.residual_histogram(scored_regression(spark, sf_dir)), 3)


@R.add(f"""WITH s AS ({BINARY_SQL}) SELECT f AS feature, count(x)::BIGINT AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max
FROM (SELECT 'prob_0' AS f, prob_0 AS x FROM s UNION ALL SELECT 'prob_1', prob_1 FROM s) GROUP BY 1""")
def probability_stats(spark, sf_dir):
    return rounded(evaluate.probability_stats(scored_binary(spark, sf_dir)), 6)


@R.add(f"""SELECT predicted AS class, count(*)::BIGINT AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
FROM ({MULTI_SQL}) GROUP BY 1""")
def prediction_distribution(spark, sf_dir):
    return evaluate.prediction_distribution(scored_multi(spark, sf_dir))


@R.add(f"""SELECT round(avg(predicted), 3) AS mean, round(quantile_cont(predicted, 0.5), 3) AS median, round(stddev_samp(predicted), 3) AS std,
  round(min(predicted), 3) AS min, round(max(predicted), 3) AS max, round(avg(residual), 3) AS mean_residual,
  round(avg(abs(residual)), 3) AS mean_absolute_error, round(sqrt(avg(residual * residual)), 3) AS root_mean_squared_error,
  round(1 - sum(residual * residual) / (var_pop(actual) * count(*)), 3) AS r2 FROM ({REGRESSION_SQL})""")
def prediction_stats(spark, sf_dir):
    return rounded(evaluate.prediction_stats(scored_regression(spark, sf_dir), "predicted", "actual"), 3)


CONF_SQL = f"""(SELECT *, CASE predicted WHEN 'A' THEN prob_A WHEN 'N' THEN prob_N ELSE prob_R END AS confidence,
  round(greatest(prob_A, prob_N, prob_R) - (prob_A + prob_N + prob_R - greatest(prob_A, prob_N, prob_R) - least(prob_A, prob_N, prob_R)), 4) AS top2_margin,
  actual <> predicted AS is_error FROM ({MULTI_SQL}))"""
TIE = "l_orderkey, l_linenumber, l_extendedprice"
TIES = ["l_orderkey", "l_linenumber", "l_extendedprice"]


@R.add(f"""SELECT l_orderkey, l_linenumber, actual, predicted, confidence, is_error FROM {CONF_SQL}
ORDER BY is_error DESC, confidence NULLS LAST, {TIE} LIMIT 20""")
def worst_errors_cls(spark, sf_dir):
    out = errors.ranked_predictions(scored_multi(spark, sf_dir), 20, True, TIES)
    return out.select("l_orderkey", "l_linenumber", "actual", "predicted", "confidence", "is_error")


@R.add(f"""SELECT l_orderkey, l_linenumber, actual, predicted, confidence, is_error FROM {CONF_SQL}
WHERE NOT is_error ORDER BY confidence DESC NULLS LAST, {TIE} LIMIT 20""")
def best_hits_cls(spark, sf_dir):
    out = errors.ranked_predictions(scored_multi(spark, sf_dir), 20, False, TIES)
    return out.select("l_orderkey", "l_linenumber", "actual", "predicted", "confidence", "is_error")


@R.add(f"""WITH s AS {CONF_SQL}, k AS (SELECT actual AS class, count(*) AS rows, count(*) FILTER (is_error) AS errors FROM s GROUP BY 1),
h AS (SELECT *, round(errors / sum(errors) OVER (), 4) AS error_share, round(rows / sum(rows) OVER (), 4) AS prevalence FROM k)
SELECT class, rows::BIGINT AS rows, errors::BIGINT AS errors, error_share, prevalence, error_share > prevalence * 1.5 AS overrepresented FROM h""")
def class_error_shares(spark, sf_dir):
    return errors.class_error_shares(scored_multi(spark, sf_dir))


@R.add(f"""SELECT count(*) FILTER (is_error)::BIGINT AS error_count, round(avg(is_error::INT), 4) AS error_rate,
  count(*) FILTER (is_error AND confidence > 0.9)::BIGINT AS confident_errors,
  count(*) FILTER (is_error AND top2_margin < 0.1 AND confidence < 0.6)::BIGINT AS close_calls FROM {CONF_SQL}""")
def error_summary_cls(spark, sf_dir):
    return errors.error_summary(scored_multi(spark, sf_dir))


@R.add(f"""WITH s AS ({BINARY_SQL}), e AS (SELECT *, actual <> predicted AS bad, CASE WHEN predicted = 1 THEN prob_1 ELSE prob_0 END AS conf,
  round(abs(prob_1 - prob_0), 4) AS margin FROM s),
k AS (SELECT actual, round(count(*) FILTER (bad) / (SELECT count(*) FROM e WHERE bad), 4) AS es, round(count(*) / (SELECT count(*) FROM e), 4) AS pv FROM e GROUP BY 1)
SELECT 'overrepresented_class' AS code FROM k WHERE es > pv * 1.5
UNION ALL SELECT 'confident_errors' FROM e WHERE bad AND conf > 0.9 HAVING count(*) > 0
UNION ALL SELECT 'close_calls' FROM e WHERE bad AND margin < 0.1 AND conf < 0.6 HAVING count(*) > 0""")
def error_hints_cls(spark, sf_dir):
    return errors.error_hints(scored_binary(spark, sf_dir)).select("code")


@R.add(f"""SELECT *, (confidence < 0.4) AS flagged_low_confidence FROM (SELECT l_orderkey, l_linenumber, predicted, confidence FROM {CONF_SQL})""")
def low_confidence_flag(spark, sf_dir):
    df = errors.with_confidence(scored_multi(spark, sf_dir))
    return errors.flag_low_confidence(df, 0.4).select(
        "l_orderkey", "l_linenumber", "predicted", "confidence", "flagged_low_confidence"
    )


def worst_reg_sql(way):
    return f"""SELECT l_orderkey, l_linenumber, actual, round(abs(residual), 4) AS abs_residual,
  round(abs(residual) / nullif(actual, 0) * 100, 2) AS residual_pct FROM ({REGRESSION_SQL})
ORDER BY abs(residual) {way}, l_orderkey, l_linenumber, actual LIMIT 20"""


def _worst_reg(spark, sf_dir, worst):
    out = errors.ranked_residuals(scored_regression(spark, sf_dir), 20, worst, ["l_orderkey", "l_linenumber", "actual"])
    return rounded(out.select("l_orderkey", "l_linenumber", "actual", "abs_residual", "residual_pct"), 4, ["abs_residual"])


@R.add(worst_reg_sql("DESC"))
def worst_errors_reg(spark, sf_dir):
    return _worst_reg(spark, sf_dir, True)


@R.add(worst_reg_sql("ASC"))
def best_hits_reg(spark, sf_dir):
    return _worst_reg(spark, sf_dir, False)


@R.add(f"""SELECT round(avg(abs(residual)), 4) AS mean_abs_residual, round(quantile_cont(abs(residual), 0.5), 4) AS median_abs_residual,
  round(max(abs(residual)), 4) AS max_abs_residual, round(avg(residual), 4) AS mean_residual,
  CASE WHEN abs(avg(residual)) > 0.2 * avg(abs(residual)) THEN CASE WHEN avg(residual) < 0 THEN 'over-predicting' ELSE 'under-predicting' END END AS bias,
  round(corr(actual, abs(residual)), 4) AS size_correlation, abs(corr(actual, abs(residual))) > 0.3 AS heteroscedastic
FROM ({REGRESSION_SQL})""")
def error_summary_reg(spark, sf_dir):
    return errors.residual_summary(scored_regression(spark, sf_dir))


@R.add("""SELECT 'bias' AS code FROM (SELECT avg(o_totalprice - 1000) AS m, avg(abs(o_totalprice - 1000)) AS a FROM orders) WHERE abs(m) > 0.2 * a
UNION ALL SELECT 'heteroscedastic' FROM (SELECT corr(o_totalprice, abs(o_totalprice - 1000)) AS r FROM orders) WHERE abs(r) > 0.3""")
def error_hints_reg(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("actual"), F.lit(1000.0).alias("predicted"))
    return errors.residual_hints(df).select("code")


@R.add("""SELECT o_orderkey, o_totalprice AS actual, 150000.0::DOUBLE AS predicted, o_orderstatus FROM orders""")
def join_predictions(spark, sf_dir):
    """Predictions and rows kept apart, paired again by key."""
    df = table(spark, sf_dir, "orders")
    predictions = df.select("o_orderkey", F.col("o_totalprice").alias("actual"), F.lit(150000.0).alias("predicted"))
    return errors.join_predictions(predictions, df.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
