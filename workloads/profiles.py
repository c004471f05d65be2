"""Profile and correlation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.operators import correlation, profile
from workloads.common import Registry, rounded, table

R = Registry()

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy(spark, sf_dir):
    """lineitem with zeros turned into gaps, a mostly empty and a constant column."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_quantity") > 45, F.col("l_quantity")).alias("rare"),
        F.lit(5.0).alias("fixed"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        "l_linestatus",
    )


GAPPY = """(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount,
  nullif(l_tax, 0.0) AS l_tax, CASE WHEN l_quantity > 45 THEN l_quantity END AS rare, 5.0::DOUBLE AS fixed,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_linestatus FROM lineitem)"""


def missing_sql(columns, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (count(*) - count({c}))::BIGINT AS missing_count, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM {source}"
        for c in columns
    )


GAPPY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rare", "fixed", "flag", "l_linestatus"]


def numeric_sql(columns, source, label):
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS feature, {str(c == label).lower()} AS is_label, count({c})::BIGINT AS count,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min,
  round(any_value(q1), 4) AS q25, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q75,
  round(max({c}), 4)::DOUBLE AS max,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
  round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS outlier_count,
  round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(*), 2) AS outlier_pct
FROM {source} AS s, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
  quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source} AS q)""")
    return " UNION ALL ".join(parts)


@R.add("""SELECT count(*)::BIGINT AS rows, 11 AS columns, 8 AS numeric_columns, 3 AS categorical_columns,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)))::BIGINT AS duplicate_rows FROM lineitem""")
def dataset_overview(spark, sf_dir):
    return profile.overview(table(spark, sf_dir, "lineitem")).drop("dtype_breakdown")


@R.add("""SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT
  AS duplicate_rows FROM lineitem""")
def duplicate_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return profile.overview(df).select("duplicate_rows")


@R.add(missing_sql(GAPPY_COLUMNS, GAPPY))
def missing_values(spark, sf_dir):
    return profile.missing_values(gappy(spark, sf_dir))


@R.add(f"SELECT sum(missing_count)::BIGINT AS total_missing_cells, count(*) FILTER (missing_count > 0)::BIGINT "
       f"AS columns_with_missing FROM ({missing_sql(GAPPY_COLUMNS, GAPPY)})")
def missing_totals(spark, sf_dir):
    return profile.missing_totals(profile.missing_values(gappy(spark, sf_dir)))


@R.add(numeric_sql(NUMERIC, "lineitem", "l_extendedprice"))
def numeric_profile(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), "l_extendedprice", NUMERIC))


@R.add(numeric_sql(["value"], "events", None))
def skewed_profile(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "events"), None, ["value"]))


@R.add("""SELECT 'value' AS feature, outlier_count, outlier_pct FROM (""" + numeric_sql(["value"], "events", None) + ")")
def iqr_outliers(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "events"), None, ["value"]).select(
        "feature", "outlier_count", "outlier_pct"
    )


def categorical_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(DISTINCT {c})::BIGINT AS nunique,
  (count(*) - count({c}))::BIGINT AS missing_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
  (SELECT {c}::VARCHAR FROM {source} AS s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS top_value,
  (SELECT count(*) FROM {source} AS s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1)::BIGINT AS top_value_count,
  round((SELECT count(*) FROM {source} AS s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1)
        * 100.0::DOUBLE / count(*), 2) AS top_value_pct FROM {source} AS t"""
        for c in columns
    )


@R.add(categorical_sql(["flag", "l_linestatus"], GAPPY))
def categorical_profile(spark, sf_dir):
    return profile.categorical_profile(gappy(spark, sf_dir))


@R.add(categorical_sql(["url", "html"], "pages"))
def high_cardinality_profile(spark, sf_dir):
    return profile.categorical_profile(table(spark, sf_dir, "pages"))


@R.add("""SELECT o_orderpriority AS class, count(*)::BIGINT AS count,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 2) AS pct FROM orders GROUP BY 1""")
def label_profile_cls(spark, sf_dir):
    return profile.label_classes(table(spark, sf_dir, "orders"), "o_orderpriority")


@R.add("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS s FROM c)
SELECT 'quality' AS label, 'classification' AS type, 0::BIGINT AS missing_count, count(*)::BIGINT AS nunique,
  round((max(n) * 100.0::DOUBLE / any_value(s)) / (min(n) * 100.0::DOUBLE / any_value(s)), 2) AS imbalance_ratio FROM c, t""")
def label_imbalance(spark, sf_dir):
    return profile.label_summary(table(spark, sf_dir, "labels"), "quality").drop("class_counts", "dtype")


@R.add("""SELECT 'o_totalprice' AS label, 'regression' AS type, 0::BIGINT AS missing_count,
  count(DISTINCT o_totalprice)::BIGINT AS nunique, round(avg(o_totalprice), 4) AS mean,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std,
  round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(skewness(o_totalprice), 4) AS skew
FROM orders""")
def label_profile_reg(spark, sf_dir):
    return rounded(profile.label_summary(table(spark, sf_dir, "orders"), "o_totalprice").drop("dtype"))


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "net", "gross", "fixed"]


def correlated(spark, sf_dir):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.nullif(off, F.lit(0.0)).alias("l_discount"),
        (price * (1 - off)).alias("net"),
        (price * (1 + F.col("l_tax"))).alias("gross"),
        F.lit(5.0).alias("fixed"),
        (price * (1 - off) + 300 * F.col("l_quantity")).alias("target"),
    )


CORRELATED_SQL = """(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount,
  l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, 5.0::DOUBLE AS fixed,
  l_extendedprice * (1 - l_discount) + 300 * l_quantity AS target FROM lineitem)"""


def corr_sql(columns, source):
    cells = []
    for k, (a, b) in enumerate(combinations(columns, 2)):
        r = f"corr({a}, {b})" if "fixed" not in (a, b) else "NULL::DOUBLE"
        cells.append(
            f"SELECT {k}::BIGINT AS pair, '{a}' AS feature_a, '{b}' AS feature_b, {r} AS correlation, "
            f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)::BIGINT AS n FROM {source} AS s"
        )
    return " UNION ALL ".join(cells)


CORR = corr_sql([*CORRELATED, "target"], CORRELATED_SQL)


@R.add(f"SELECT pair, feature_a, feature_b, round(correlation, 6) AS correlation, n FROM ({CORR})")
def correlation_long(spark, sf_dir):
    return rounded(correlation.correlation_long(correlated(spark, sf_dir), "target"), 6)


PAIRS = f"SELECT pair, feature_a, feature_b, round(correlation, 6) AS correlation FROM ({CORR}) WHERE abs(correlation) >= 0.9"


@R.add(PAIRS)
def correlated_pairs(spark, sf_dir):
    return correlation.correlated_pairs(correlation.correlation_long(correlated(spark, sf_dir), "target")).drop("n")


DROPS = f"""
WITH c AS ({CORR}), l AS (SELECT feature_a AS f, abs(correlation) AS r FROM c WHERE feature_b = 'target'),
p AS (SELECT pair, feature_a, feature_b, round(correlation, 6) AS r FROM c
      WHERE abs(correlation) >= 0.9 AND feature_b <> 'target'),
j AS (SELECT p.*, a.r AS ra, b.r AS rb FROM p JOIN l a ON a.f = feature_a JOIN l b ON b.f = feature_b),
d AS (SELECT pair, CASE WHEN ra <= rb THEN feature_a ELSE feature_b END AS feature,
        CASE WHEN ra <= rb THEN feature_b ELSE feature_a END AS correlated_with, r AS pair_correlation,
        round(least(ra, rb), 6) AS label_correlation FROM j)
SELECT feature, correlated_with, pair_correlation, label_correlation FROM d
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(pair_correlation) DESC, pair) = 1"""


@R.add(DROPS)
def drop_recommendations(spark, sf_dir):
    corr = correlation.correlation_long(correlated(spark, sf_dir), "target")
    return correlation.drop_recommendations(corr, "target").drop("reason", "kept_label_correlation")


@R.add(f"""WITH n AS ({numeric_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rare", "fixed"], GAPPY, "l_quantity")}),
m AS ({missing_sql(GAPPY_COLUMNS, GAPPY)})
SELECT feature, 'low_variance' AS flag, std AS value FROM n WHERE std < 0.01 AND NOT is_label
UNION ALL SELECT feature, 'high_missing', missing_pct FROM m WHERE missing_pct > 50
UNION ALL SELECT feature, 'outliers', outlier_pct FROM n WHERE outlier_pct > 5""")
def quality_flags(spark, sf_dir):
    return rounded(profile.quality_flags(gappy(spark, sf_dir), "l_quantity"))


DEEP_NUMERIC = numeric_sql(["value", "user_id"], "events", None)


@R.add(f"""SELECT feature, 'numeric' AS kind, round(skew, 3) AS skew, outlier_pct, NULL::BIGINT AS cardinality,
  NULL::VARCHAR AS top_value, CASE WHEN skew > 1 AND min >= 0 THEN 'log' END AS transform
FROM ({DEEP_NUMERIC}) UNION ALL
SELECT feature, 'categorical', NULL, NULL, nunique, top_value, CASE WHEN nunique BETWEEN 2 AND 20 THEN 'onehot' END
FROM ({categorical_sql(["event_type"], "events")})""")
def deep_profile(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value", "user_id", "event_type", "event_id")
    return profile.deep_profile(df, "event_id").drop("recommendation")


@R.add(f"""WITH d AS ({DROPS}), m AS ({missing_sql([*CORRELATED, "target"], CORRELATED_SQL)})
SELECT feature, CASE WHEN feature = 'target' THEN 'label' ELSE 'numeric' END AS kind, missing_pct,
  feature IN (SELECT feature FROM d) AS advised_drop FROM m""")
def quick_profile(spark, sf_dir):
    df = correlated(spark, sf_dir)
    advice = correlation.drop_recommendations(correlation.correlation_long(df, "target"), "target")
    return profile.quick_profile(df, "target", [r["feature"] for r in advice.select("feature").collect()])
