"""Leakage and explanation queries. The model is a formula, so SQL can follow every step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import explain, leakage, report
from workloads.common import Registry, rounded, table

R = Registry()


# ---- leakage

def order_features(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select(
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_orderstatus") == "F").alias("finished"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("openness"),
        (F.col("o_totalprice") > 250000).alias("pricey"),
        F.when(F.col("o_totalprice") > 400000, 1).otherwise(0).alias("top"),
    )


LEAK_SQL = """
WITH o AS (SELECT o_orderkey, o_orderstatus AS y, (o_orderstatus = 'F')::INT AS finished,
    CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS openness, (o_totalprice > 250000)::INT AS pricey,
    (o_totalprice > 400000)::INT AS top,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', o_orderkey, '42'))) - 1 AS i FROM orders),
c AS (SELECT y AS g, count(*) AS n, sum(count(*)) OVER (ORDER BY y) - count(*) AS start FROM o GROUP BY 1),
f AS (SELECT g, fold, (SELECT count(*) FROM range(n::BIGINT) t(j) WHERE (start + j) % 3 = fold) AS size FROM c, range(3) k(fold)),
e AS (SELECT g, fold, sum(size) OVER (PARTITION BY g ORDER BY fold) AS hi, size FROM f),
r AS (SELECT o.*, fold FROM o JOIN e ON g = y AND i < hi AND i >= hi - size),
l AS (UNPIVOT (SELECT y, fold, finished, openness, pricey, top FROM r) ON finished, openness, pricey, top INTO NAME feature VALUE x),
n AS (SELECT feature, fold, x, y, count(*) AS n FROM l GROUP BY ALL),
vote AS (SELECT feature, k.fold AS held, x, y AS said, row_number() OVER (PARTITION BY feature, k.fold, x ORDER BY sum(n) DESC, y) AS rk
  FROM n JOIN range(3) k(fold) ON n.fold <> k.fold GROUP BY feature, k.fold, x, y),
recall AS (SELECT n.feature, n.fold, n.y, sum(CASE WHEN said = n.y THEN n ELSE 0 END) / sum(n) AS rec
  FROM n JOIN vote v ON v.feature = n.feature AND v.held = n.fold AND v.x = n.x AND rk = 1 GROUP BY 1, 2, 3),
s AS (SELECT feature, fold, avg(rec) AS b FROM recall GROUP BY 1, 2)
SELECT feature, (SELECT count(*) FROM orders)::BIGINT AS rows, round(avg(b), 4) AS score FROM s GROUP BY 1"""


@R.add(LEAK_SQL)
def leakage_two_valued(spark, sf_dir):
    """Two-valued features: the tree is one vote per value, which SQL can repeat."""
    return leakage.leakage_scores(order_features(spark, sf_dir), "o_orderstatus", ["o_orderkey"])


@R.add()
def leakage_scores(spark, sf_dir):
    """Numbers, dates and near-unique text against a 0/1 label, with a planted copy."""
    df = table(spark, sf_dir, "events").select(
        "event_id", "ts", "value", "user_id", "props",
        (F.col("event_type") == "purchase").cast("int").alias("bought"),
        F.when(F.col("event_type") == "purchase", F.col("value") + 1e6).otherwise(F.col("value")).alias("receipt"),
    )
    return leakage.leakage_scores(df, "bought", ["event_id"])


@R.add()
def leakage_scores_reg(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice",
        F.log("o_totalprice").alias("log_price"),
    )
    return leakage.leakage_scores(df, "o_totalprice", ["o_orderkey"])


@R.add(f"""SELECT feature, rows, score, score >= 0.95 AS suspected FROM ({LEAK_SQL})""")
def leakage_verdicts(spark, sf_dir):
    scores = leakage.leakage_scores(order_features(spark, sf_dir), "o_orderstatus", ["o_orderkey"])
    return leakage.leakage_verdicts(scores).drop("reason")


@R.add(f"""WITH s AS ({LEAK_SQL}) SELECT count(*) FILTER (score >= 0.6)::BIGINT AS suspects,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (score >= 0.6), '') AS drop_list FROM s""")
def leakage_hints(spark, sf_dir):
    scores = leakage.leakage_scores(order_features(spark, sf_dir), "o_orderstatus", ["o_orderkey"])
    hints = leakage.leakage_hints(leakage.leakage_verdicts(scores, 0.6), 0.6)
    return hints.select("suspects", F.concat_ws(",", "drop_list").alias("drop_list"))


# ---- formula model over orders

FEATURES = ["price", "month", "cust"]
SOURCE = """(SELECT o_orderkey, o_totalprice / 100000 AS price, month(o_orderdate)::DOUBLE AS month,
  o_custkey::DOUBLE AS cust, o_totalprice / 100000 + 0.02 * (o_custkey % 7) AS truth FROM orders)"""


def formula_sql(p, m, c):
    return f"({p} + 0.0137 * {m} * {m} - 0.0526317 * {p} * {m} + {c} / 4999)"


def frame(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 100000).alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.col("o_custkey").cast("double").alias("cust"),
        (F.col("o_totalprice") / 100000 + 0.02 * (F.col("o_custkey") % 7)).alias("truth"),
    )


def predict(df):
    p, m, c = F.col("price"), F.col("month"), F.col("cust")
    return df.withColumn("prediction", p + 0.0137 * m * m - 0.0526317 * p * m + c / 4999)


def importance_sql():
    parts = []
    for f in FEATURES:
        args = [f"coalesce(lag({x}) OVER w, last_value({x}) OVER a)" if x == f else x for x in FEATURES]
        parts.append(f"""SELECT '{f}' AS feature, base, sqrt(avg((y - truth) * (y - truth))) AS shuffled FROM
 (SELECT truth, {formula_sql(*args)} AS y, (SELECT sqrt(avg(({formula_sql(*FEATURES)} - truth) * ({formula_sql(*FEATURES)} - truth))) FROM {SOURCE}) AS base
  FROM (SELECT *, md5(concat_ws('|', o_orderkey, '42')) AS h,
     floor(('0x' || substr(md5(concat_ws('|', o_orderkey, '42')), 1, 4))::INT * ceil((SELECT count(*) FROM orders) / 100000.0) / 65536) AS b FROM {SOURCE})
  WINDOW w AS (PARTITION BY b ORDER BY h), a AS (PARTITION BY b ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY base""")
    return "SELECT feature, round(shuffled - base, 5) AS importance, 0.0::DOUBLE AS stddev FROM (" + " UNION ALL ".join(parts) + ")"


@R.add(importance_sql())
def permutation_importance(spark, sf_dir):
    score = -F.sqrt(F.avg((F.col("prediction") - F.col("truth")) ** 2))
    out = explain.permutation_importance(frame(spark, sf_dir), FEATURES, ["o_orderkey"], predict, score)
    return rounded(out, 5)


def auc_importance_sql():
    """AUC by average ranks of the scores, for the rows as they are and with one feature shuffled at a time."""
    copies = [f"SELECT '_base' AS tag, truth > 1.6 AS hit, round({formula_sql(*FEATURES)}, 3) AS y FROM {SOURCE}"]
    for f in FEATURES:
        args = [f"coalesce(lag({x}) OVER w, last_value({x}) OVER a)" if x == f else x for x in FEATURES]
        copies.append(f"""SELECT '{f}', truth > 1.6, round({formula_sql(*args)}, 3)
 FROM (SELECT *, md5(concat_ws('|', o_orderkey, '42')) AS h,
     floor(('0x' || substr(md5(concat_ws('|', o_orderkey, '42')), 1, 4))::INT * ceil((SELECT count(*) FROM orders) / 100000.0) / 65536) AS b FROM {SOURCE})
  WINDOW w AS (PARTITION BY b ORDER BY h), a AS (PARTITION BY b ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
    return f"""WITH c AS ({" UNION ALL ".join(copies)}),
r AS (SELECT tag, hit, rank() OVER (PARTITION BY tag ORDER BY y) + (count(*) OVER (PARTITION BY tag, y) - 1) / 2.0 AS r FROM c),
s AS (SELECT tag, count_if(hit)::DOUBLE AS p, count_if(NOT hit)::DOUBLE AS n, sum(CASE WHEN hit THEN r END) AS r FROM r GROUP BY 1),
auc AS (SELECT tag, (r - p * (p + 1) / 2) / (p * n) AS auc FROM s)
SELECT tag AS feature, round((SELECT auc FROM auc WHERE tag = '_base') - auc, 5) AS importance, 0.0::DOUBLE AS stddev FROM auc WHERE tag <> '_base'"""


@R.add(auc_importance_sql())
def auc_importance(spark, sf_dir):
    """Drop of the ROC AUC per shuffled feature; scores are rounded so that there are ties."""
    df = frame(spark, sf_dir).withColumn("hit", F.col("truth") > 1.6)

    def tied(rows):
        return predict(rows).withColumn("prediction", F.round("prediction", 3))

    score = explain.auc_score(df, tied, "hit", True)
    return rounded(explain.permutation_importance(df, FEATURES, ["o_orderkey"], tied, score), 5)


def shap_sql(background=25):
    value = {f: f"CASE WHEN s & {1 << i} > 0 THEN o.{f} ELSE b.{f} END" for i, f in enumerate(FEATURES)}
    weights = "[1/3.0::DOUBLE, 1/6.0::DOUBLE, 1/3.0::DOUBLE]"
    sums = " UNION ALL ".join(
        f"""SELECT o_orderkey, '{f}' AS feature, sum(v * CASE WHEN s & {1 << i} > 0 THEN {weights}[bit_count(s::BIGINT)]
  ELSE -{weights}[bit_count(s::BIGINT) + 1] END) AS shap_value FROM v GROUP BY 1"""
        for i, f in enumerate(FEATURES)
    )
    return f"""(WITH o AS (SELECT * FROM {SOURCE}),
b AS (SELECT * FROM o ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT {background}),
v AS (SELECT o.o_orderkey, s, avg({formula_sql(*value.values())}) AS v FROM o, b, range(8) t(s) GROUP BY 1, 2)
{sums})"""


SHAP = shap_sql()


def shap(spark, sf_dir):
    return explain.shapley_values(
        frame(spark, sf_dir), FEATURES, ["o_orderkey"], predict, background_rows=25, max_rows=None
    )


@R.add(f"SELECT o_orderkey, feature, round(shap_value, 6) AS shap_value FROM {SHAP}")
def shap_values(spark, sf_dir):
    return rounded(shap(spark, sf_dir).select("o_orderkey", "feature", "shap_value"), 6)


@R.add(f"""SELECT o_orderkey, round({formula_sql(*FEATURES)}, 6) AS total FROM {SOURCE}""")
def shap_additivity(spark, sf_dir):
    """Base value plus the row's values is the prediction."""
    rows = shap(spark, sf_dir).groupBy("o_orderkey").agg(
        (F.first("base_value") + F.sum("shap_value")).alias("total")
    )
    return rounded(rows, 6)


SUMMARY = f"SELECT feature, avg(abs(shap_value)) AS m FROM {SHAP} GROUP BY 1"


@R.add(f"SELECT feature, round(m, 6) AS mean_abs_shap, row_number() OVER (ORDER BY m DESC)::INT AS rank FROM ({SUMMARY})")
def shap_summary(spark, sf_dir):
    return rounded(explain.shap_summary(shap(spark, sf_dir)), 6)


@R.add(f"""SELECT o_orderkey, string_agg(feature, ',' ORDER BY abs(shap_value) DESC, feature) AS top FROM
(SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(shap_value) DESC, feature) AS k FROM {SHAP}) WHERE k <= 2 GROUP BY 1""")
def shap_top_features(spark, sf_dir):
    out = explain.shap_top_features(shap(spark, sf_dir), ["o_orderkey"], 2)
    return out.select("o_orderkey", F.concat_ws(",", "top_features.feature").alias("top"))


@R.add(f"""WITH w AS (PIVOT {SHAP} ON feature IN ('price', 'month', 'cust') USING first(shap_value) GROUP BY o_orderkey),
s AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS k FROM ({SUMMARY})),
r AS (SELECT 'price' AS a, 'month' AS b, corr(price, month) AS r FROM w UNION ALL SELECT 'price', 'cust', corr(price, cust) FROM w
  UNION ALL SELECT 'month', 'cust', corr(month, cust) FROM w)
SELECT CASE WHEN x.k < y.k THEN a ELSE b END AS feature_a, CASE WHEN x.k < y.k THEN b ELSE a END AS feature_b,
  round(r, 4) AS corr, abs(round(r, 4)) AS abs_corr FROM r JOIN s x ON x.feature = a JOIN s y ON y.feature = b""")
def shap_interactions(spark, sf_dir):
    return explain.shap_interactions(shap(spark, sf_dir), ["o_orderkey"]).drop("hint")


def pdp_sql():
    parts = []
    for f in ("price", "month"):
        args = [f"(lo + (hi - lo) * i / 19)" if x == f else x for x in FEATURES]
        parts.append(f"""SELECT '{f}' AS feature, i::INT AS position, round(avg({formula_sql(*args)}), 6) AS pdp
 FROM {SOURCE} AS o, (SELECT min({f}) AS lo, max({f}) AS hi FROM {SOURCE}) AS g, range(20) t(i) GROUP BY i""")
    return " UNION ALL ".join(parts)


@R.add(pdp_sql())
def partial_dependence(spark, sf_dir):
    out = explain.partial_dependence(
        frame(spark, sf_dir), predict, ["price", "month"], ["o_orderkey"], sample_size=None
    )
    return out.select("feature", "position", "pdp")


@R.add("""SELECT 'o_orderpriority' AS feature, p AS grid, round(avg(o_totalprice / 100000 + length(p)), 6) AS pdp
FROM orders, (SELECT DISTINCT o_orderpriority AS p FROM orders) GROUP BY 2""")
def partial_dependence_categories(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")

    def by_length(x):
        return x.withColumn("prediction", F.col("o_totalprice") / 100000 + F.length("o_orderpriority"))

    out = explain.partial_dependence(df, by_length, ["o_orderpriority"], ["o_orderkey"], sample_size=None)
    return out.select("feature", "grid", "pdp")


@R.add(f"""WITH c AS ({pdp_sql()}), d AS (SELECT *, pdp - lag(pdp) OVER (PARTITION BY feature ORDER BY position) AS d FROM c)
SELECT feature, CASE WHEN min(d) >= 0 THEN 'increasing' WHEN max(d) <= 0 THEN 'decreasing' WHEN max(pdp) - min(pdp) > 0.05 THEN 'non-monotonic' END AS shape,
  round(max(pdp) - min(pdp), 6) AS span FROM d GROUP BY 1""")
def pdp_shape(spark, sf_dir):
    curves = explain.partial_dependence(
        frame(spark, sf_dir), predict, ["price", "month"], ["o_orderkey"], sample_size=None
    )
    return explain.pdp_shapes(curves)


@R.add("""SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT 500""")
def hash_sample(spark, sf_dir):
    """The 500-row explanation sample."""
    from tablewright.operators.sampling import hash_sample as sample

    return sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@R.add(f"""SELECT (SELECT count(*)::BIGINT FROM orders) AS n_rows, 3::BIGINT AS n_features, round(avg({formula_sql(*FEATURES)}), 6) AS base_value
FROM (SELECT * FROM {SOURCE} ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT 25)""")
def explanation_metadata(spark, sf_dir):
    """The metadata row beside the explanation tables."""
    out = report.explanation_tables(shap(spark, sf_dir), ["o_orderkey"], FEATURES)["metadata"]
    return rounded(out.select("n_rows", "n_features", "base_value"), 6)
