"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import drift
from workloads.common import Registry, rounded, table

R = Registry()

FEATURES = ["l_discount", "l_extendedprice", "l_orderkey", "l_quantity", "l_tax"]
CUT = "1998-06-01"


def sides(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    keep = [*FEATURES, F.month("l_shipdate").alias("ship_month")]
    early = df.where(F.col("l_shipdate") < cut).select(*keep)
    late = df.where(F.col("l_shipdate") >= cut)
    return early, late.select(
        *[c for c in FEATURES if c != "l_quantity"],
        (F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 15).otherwise(0)).alias("l_quantity"),
        F.month("l_shipdate").alias("ship_month"),
    )


def drift_sql(features, early, late):
    parts = []
    for f in features:
        parts.append(f"""
SELECT '{f}' AS feature, x.*, e.*, h.psi FROM
 (SELECT round(avg({f}), 4) AS train_mean, round(stddev_samp({f}), 4) AS train_std, avg({f}) AS tm FROM {early}) e,
 (SELECT round(avg({f}), 4) AS predict_mean, round(stddev_samp({f}), 4) AS predict_std, avg({f}) AS pm,
         count({f}) AS pn FROM {late}) x,
 (WITH q AS (SELECT list_sort(list_distinct(quantile_cont({f}::DOUBLE, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM {early}),
   b AS (SELECT i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS last FROM q, range(1, 11) r(i) WHERE i < len(e)),
   n AS (SELECT i, (SELECT count(*) FROM {early} WHERE {f} >= lo AND ({f} < hi OR (last AND {f} <= hi))) AS a,
                (SELECT count(*) FROM {late} WHERE {f} >= lo AND ({f} < hi OR (last AND {f} <= hi))) AS p FROM b),
   s AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS a, greatest(p / nullif(sum(p) OVER (), 0), 1e-6) AS p, p AS cnt FROM n)
  SELECT round(sum((p - a) * ln(p / a)), 6) AS psi, sum(cnt)::BIGINT AS in_range_rows FROM s) h""")
    body = " UNION ALL BY NAME ".join(f"SELECT * FROM ({p})" for p in parts).replace("h.psi FROM", "h.psi, h.in_range_rows FROM")
    return f"""SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'significant_drift' WHEN psi >= 0.1 THEN 'moderate_drift' ELSE 'no_drift' END AS status,
  train_mean, predict_mean, round(CASE WHEN tm <> 0 THEN abs(pm - tm) / abs(tm) * 100 ELSE 0 END, 2) AS mean_shift_pct,
  train_std, predict_std, in_range_rows, round((pn - in_range_rows) * 100.0::DOUBLE / pn, 2) AS out_of_range_pct FROM ({body})"""


EARLY = f"(SELECT *, month(l_shipdate) AS ship_month FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}')"
LATE = f"""(SELECT * REPLACE (l_quantity + CASE WHEN l_returnflag = 'R' THEN 15 ELSE 0 END AS l_quantity),
  month(l_shipdate) AS ship_month FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"""
DRIFT = drift_sql([*FEATURES, "ship_month"], EARLY, LATE)


@R.add(DRIFT)
def psi_drift(spark, sf_dir):
    early, late = sides(spark, sf_dir)
    return rounded(drift.detect_drift(early, late), 4, ["train_mean", "predict_mean", "train_std", "predict_std"])


@R.add(f"""SELECT count(*)::BIGINT AS features_checked, count(*) FILTER (status = 'significant_drift')::BIGINT AS significant_drift,
  count(*) FILTER (status = 'moderate_drift')::BIGINT AS moderate_drift, count(*) FILTER (status = 'no_drift')::BIGINT AS no_drift,
  coalesce(string_agg(feature, ',' ORDER BY psi DESC, feature) FILTER (status <> 'no_drift'), '') AS drifted_features FROM ({DRIFT})""")
def drift_summary(spark, sf_dir):
    early, late = sides(spark, sf_dir)
    out = drift.drift_summary(drift.detect_drift(early, late))
    return out.withColumn("drifted_features", F.concat_ws(",", "drifted_features"))


@R.add("""SELECT 'value' AS feature, 'significant_drift' AS status, 0::BIGINT AS in_range_rows, 100.0::DOUBLE AS out_of_range_pct
FROM events HAVING count(*) > 0""")
def drift_out_of_range(spark, sf_dir):
    """Every scored value above the training range is the strongest drift."""
    df = table(spark, sf_dir, "events").select("value")
    far = df.select((F.col("value") + 1e9).alias("value"))
    return drift.detect_drift(df, far).select("feature", "status", "in_range_rows", "out_of_range_pct")
