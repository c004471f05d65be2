"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import features
from tablewright.operators.features import apply_transformations, fit_target_mean
from workloads.common import Registry, rounded, table

R = Registry()


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", (F.col("l_quantity") - 25).alias("signed"),
    )


@R.add("""SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS log_l_extendedprice,
  CASE WHEN l_quantity - 25 >= 0 THEN round(ln(1 + l_quantity - 25), 6) END AS log_signed,
  CASE WHEN l_quantity - 25 >= 0 THEN round(sqrt(l_quantity - 25), 6) END AS sqrt_signed FROM lineitem""")
def fe_log_sqrt(spark, sf_dir):
    out, _ = apply_transformations(items(spark, sf_dir), {"log": ["l_extendedprice", "signed"], "sqrt": ["signed"]})
    return rounded(out.select("l_orderkey", "l_linenumber", "log_l_extendedprice", "log_signed", "sqrt_signed"), 6)


@R.add("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS l_extendedprice_per_l_quantity,
  round(l_extendedprice / nullif(l_tax, 0), 4) AS l_extendedprice_per_l_tax FROM lineitem""")
def fe_ratio(spark, sf_dir):
    out, _ = apply_transformations(
        items(spark, sf_dir), {"ratio": [["l_extendedprice", "l_quantity"], ["l_extendedprice", "l_tax"]]}
    )
    cols = ["l_extendedprice_per_l_quantity", "l_extendedprice_per_l_tax"]
    return rounded(rounded(out.select("l_orderkey", "l_linenumber", *cols), 8, cols[:1]), 4, cols[1:])


@R.add("""SELECT l_orderkey, l_linenumber, round(l_quantity - l_discount, 6) AS l_quantity_minus_l_discount,
  round(l_quantity * l_extendedprice, 4) AS l_quantity_x_l_extendedprice FROM lineitem""")
def fe_diff_product(spark, sf_dir):
    spec = {"diff": [["l_quantity", "l_discount"]], "product": [["l_quantity", "l_extendedprice"]]}
    out, _ = apply_transformations(items(spark, sf_dir), spec)
    out = out.select("l_orderkey", "l_linenumber", "l_quantity_minus_l_discount", "l_quantity_x_l_extendedprice")
    return rounded(rounded(out, 6, ["l_quantity_minus_l_discount"]), 4, ["l_quantity_x_l_extendedprice"])


@R.add("""SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0)::BIGINT
  AS ts_minus_start FROM events""")
def fe_diff_days(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00")).alias("start")
    )
    out, _ = apply_transformations(df, {"diff": [["ts", "start"]]})
    return out.select("event_id", "ts_minus_start")


@R.add("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 10 THEN '(4.999, 10.0]'
  WHEN l_quantity > 10 AND l_quantity <= 25 THEN '(10.0, 25.0]' WHEN l_quantity > 25 AND l_quantity <= 40 THEN '(25.0, 40.0]'
  ELSE 'nan' END AS l_quantity_bin FROM lineitem""")
def fe_bin(spark, sf_dir):
    out, _ = apply_transformations(items(spark, sf_dir), {"bin": {"l_quantity": [5, 10, 25, 40]}})
    return out.select("l_orderkey", "l_linenumber", "l_quantity_bin")


@R.add("""SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  day(o_orderdate) AS o_orderdate_day, (isodow(o_orderdate) - 1) AS o_orderdate_dayofweek,
  CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS o_orderdate_is_weekend FROM orders""")
def fe_date_parts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return apply_transformations(df, {"date_parts": ["o_orderdate"]})[0].drop("o_orderdate")


@R.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE year(d) END AS d_year,
  month(CASE WHEN o_orderstatus <> 'O' THEN d END) AS d_month, day(CASE WHEN o_orderstatus <> 'O' THEN d END) AS d_day,
  (isodow(CASE WHEN o_orderstatus <> 'O' THEN d END) - 1) AS d_dayofweek,
  CASE WHEN o_orderstatus <> 'O' AND isodow(d) IN (6, 7) THEN 1 ELSE 0 END AS d_is_weekend
FROM (SELECT *, o_orderdate AS d FROM orders)""")
def fe_date_parts_text(spark, sf_dir):
    """Dates as text, a class of rows unparseable."""
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "unknown").otherwise(text).alias("d")
    )
    return apply_transformations(df, {"date_parts": ["d"]})[0].drop("d")


@R.add("""SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS l_returnflag_A,
  (l_returnflag = 'N')::INT AS l_returnflag_N, (l_returnflag = 'R')::INT AS l_returnflag_R FROM lineitem""")
def fe_onehot(spark, sf_dir):
    df = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return apply_transformations(df, {"onehot": ["l_returnflag"]})[0]


@R.add("""WITH r AS (SELECT l_suppkey AS s, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY 1),
  long AS (SELECT l_orderkey, l_linenumber, coalesce(k, 0) AS k FROM lineitem LEFT JOIN (SELECT * FROM r WHERE k <= 20) ON s = l_suppkey)
SELECT k, count(*)::BIGINT AS n FROM long GROUP BY 1""")
def fe_onehot_capped(spark, sf_dir):
    """High cardinality: 20 columns and ``_other``; column sums in rank order (0 is other)."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey")
    wide, report = apply_transformations(df, {"onehot": ["l_suppkey"]})
    sums = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in report.new_features])
    long = sums.unpivot([], report.new_features, "name", "n")
    supplier = F.try_to_number(F.regexp_extract("name", r"_(\d+)$", 1), F.lit("99999999999"))
    rows = long.select(F.col("name") != "l_suppkey__other", supplier.alias("s"), "n").toDF("named", "s", "n")
    order = F.row_number().over(_by_size())
    return rows.where("named").select(order.cast("bigint").alias("k"), "n").unionByName(
        rows.where("NOT named").select(F.lit(0).cast("bigint").alias("k"), "n")
    )


def _by_size():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("n"), "s")  # 20 rows


@R.add("""WITH g AS (SELECT o_custkey AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN n > 1 THEN (s - o_totalprice) / (n - 1) ELSE (SELECT avg(o_totalprice) FROM orders) END, 7)
  AS o_custkey_target_mean FROM orders JOIN g ON k = o_custkey""")
def fe_target_mean(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out, _ = apply_transformations(df, {"target_mean": {"o_custkey": "o_totalprice"}}, label="o_totalprice")
    return rounded(out.select("o_orderkey", "o_custkey_target_mean"), 7)


@R.add("""WITH f AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS k, l_extendedprice AS y, l_orderkey, l_linenumber FROM lineitem),
  g AS (SELECT k, sum(y) AS s, count(*) AS n FROM f WHERE k IS NOT NULL GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce((s - y) / (n - 1), (SELECT avg(y) FROM f)), 3) AS k_target_mean
FROM f LEFT JOIN g USING (k)""")
def fe_target_mean_nulls(spark, sf_dir):
    """NULL keys take the global mean instead of forming a group."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("k"),
        F.col("l_extendedprice").alias("y"),
    )
    out, _ = apply_transformations(df, {"target_mean": {"k": "y"}}, label="y")
    return rounded(out.select("l_orderkey", "l_linenumber", "k_target_mean"), 3)


@R.add("""SELECT o_orderstatus, round(m, 4) AS o_orderstatus_target_mean FROM
  (SELECT o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1)""")
def fe_target_mean_fitted(spark, sf_dir):
    stats, _ = fit_target_mean(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return rounded(stats)


@R.add("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity, 4) AS l_extendedprice_x_l_quantity,
  round(l_extendedprice * l_tax, 4) AS l_extendedprice_x_l_tax, round(l_quantity * l_tax, 4) AS l_quantity_x_l_tax FROM lineitem""")
def fe_interact(spark, sf_dir):
    """Top three features by spread, multiplied pairwise."""
    df = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    spread = df.agg(*[F.stddev(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")])
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    importance = spread.unpivot([], names, "feature", "importance")
    out, report = apply_transformations(df, {"interact_top_k": {"k": 3, "importance": importance}})
    return rounded(out.select("l_orderkey", "l_linenumber", *report.new_features))


@R.add("""SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice)::DOUBLE AS log_l_extendedprice,
  round(ln(1 + l_extendedprice) * l_quantity, 6) AS chained FROM lineitem""")
def fe_chained(spark, sf_dir):
    """A later transform reads an earlier one's output."""
    df = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out, _ = apply_transformations(df, {"log": ["l_extendedprice"], "product": [["log_l_extendedprice", "l_quantity"]]})
    return out.select(
        "l_orderkey", "l_linenumber", "log_l_extendedprice",
        F.round("log_l_extendedprice_x_l_quantity", 6).alias("chained"),
    )


@R.add("""SELECT o_orderkey, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, day(o_orderdate) AS d_day,
  (isodow(o_orderdate) - 1) AS d_dayofweek, CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS d_is_weekend,
  CASE WHEN o_orderkey % 4 = 3 THEN 7 END::BIGINT AS e_minus_d FROM orders""")
def fe_dates_as_written(spark, sf_dir):
    """One date column in four notations, and its distance to a week later where that is written."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(at, "M/d/yyyy")).when(k == 1, F.date_format(at, "d.M.yyyy"))
        .when(k == 2, F.date_format(at, "d MMM yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    )
    later = F.when(k == 3, F.date_format(at + F.expr("INTERVAL 7 DAYS"), "MMMM d, yyyy")).otherwise(F.lit("12/31/x"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("d"), F.when(k == 3, later).alias("e"))
    parts = apply_transformations(df, {"date_parts": ["d"]})[0]
    # a quarter of the rows have the later date, so the column is marked as dates by a cast
    gap = features.as_timestamp(df, "e").cast("timestamp")
    both = apply_transformations(df.withColumns({"e": gap, "d": features.as_timestamp(df, "d")}), {"diff": [["e", "d"]]})[0]
    return parts.drop("d", "e").join(both.select("o_orderkey", "e_minus_d"), "o_orderkey")
