"""Split, fold and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import splits
from workloads.common import Registry, rounded, table

R = Registry()

H = "md5(concat_ws('|', o_orderkey, '42'))"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


STRATIFIED = f"""
WITH n AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1),
q AS (SELECT g, n, ceil(0.2 * (SELECT count(*) FROM orders)) AS total,
        ceil(0.2 * (SELECT count(*) FROM orders)) * n / (SELECT count(*) FROM orders) AS exact FROM n),
s AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, g)
        <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM q)
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H}) <= take AS is_test
FROM orders JOIN s ON g = o_orderpriority"""


@R.add(STRATIFIED)
def split_stratified(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return splits.assign_test(df, ["o_orderkey"], "o_orderpriority")


@R.add(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {H}) <= ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test FROM orders""")
def split_random(spark, sf_dir):
    return splits.assign_test(orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"])


@R.add(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}) - 1 AS i FROM orders),
c AS (SELECT o_orderstatus AS g, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*) AS start FROM orders GROUP BY 1),
f AS (SELECT g, fold, (SELECT count(*) FROM range(n::BIGINT) t(j) WHERE (start + j) % 5 = fold) AS size FROM c, range(5) k(fold)),
e AS (SELECT g, fold, sum(size) OVER (PARTITION BY g ORDER BY fold) AS hi, size FROM f)
SELECT o_orderkey, o_orderstatus, fold::INT AS fold FROM r JOIN e ON g = o_orderstatus AND i < hi AND i >= hi - size""")
def kfold_stratified(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return splits.assign_folds(df, ["o_orderkey"], 5, "o_orderstatus")


@R.add(f"SELECT o_orderkey, (ntile(7) OVER (ORDER BY {H}) - 1)::INT AS fold FROM orders")
def kfold_plain(spark, sf_dir):
    return splits.assign_folds(orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"], 7)


@R.add("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS role FROM orders""")
def cutoff_split(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return splits.temporal_folds(df, "o_orderdate", ["o_orderkey"], "1997-01-01").select("o_orderkey", "role")


WALK = f"""
WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, {H}) - 1 AS i,
  count(*) OVER () // 5 AS chunk FROM orders), c AS (SELECT *, least(i // chunk, 4) AS c FROM r)
SELECT o_orderkey, o_orderdate, fold::INT AS fold, CASE WHEN c = fold THEN 'test' ELSE 'train' END AS role
FROM c JOIN range(1, 5) k(fold) ON fold >= c"""


@R.add(f"SELECT o_orderkey, fold, role FROM ({WALK})")
def walk_forward(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return splits.walk_forward(df, "o_orderdate", ["o_orderkey"], 4).drop("o_orderdate")


@R.add(f"""SELECT fold, role, count(*)::BIGINT AS rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM ({WALK}) GROUP BY 1, 2""")
def fold_ranges(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return splits.fold_ranges(splits.walk_forward(df, "o_orderdate", ["o_orderkey"], 4), "o_orderdate")


@R.add(f"""WITH s AS ({STRATIFIED}), j AS (SELECT o.*, is_test FROM orders o JOIN s USING (o_orderkey)),
q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c
      FROM j WHERE NOT is_test)
SELECT o_orderkey, is_test, round((o_totalprice - b) / (c - a), 6) AS o_totalprice FROM j, q""")
def robust_scale(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    train, test = splits.train_test_split(df, "o_orderpriority", ["o_orderkey"])
    a, b = splits.robust_scale(train, [test], ["o_totalprice"])
    both = a.withColumn("is_test", F.lit(False)).unionByName(b.withColumn("is_test", F.lit(True)))
    return rounded(both.select("o_orderkey", "is_test", "o_totalprice"), 6)


@R.add(f"""WITH f AS (SELECT ntile(5) OVER (ORDER BY {H}) - 1 AS fold, o_totalprice FROM orders),
s AS (SELECT fold, 'mean' AS metric, avg(o_totalprice) AS score FROM f GROUP BY 1
  UNION ALL SELECT fold, 'spread', stddev_samp(o_totalprice) FROM f GROUP BY 1)
SELECT metric, round(avg(score), 3) AS mean, round(stddev_pop(score), 3) AS std, count(*)::BIGINT AS folds FROM s GROUP BY 1""")
def fold_scores(spark, sf_dir):
    folds = splits.assign_folds(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 5)
    scores = folds.groupBy("fold").agg(
        F.create_map(
            F.lit("mean"), F.avg("o_totalprice"), F.lit("spread"), F.stddev_samp("o_totalprice")
        ).alias("scores")
    )
    return rounded(splits.aggregate_score_maps(scores), 3)


@R.add(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, {H})::BIGINT AS row_number FROM orders")
def global_row_number(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return splits.global_row_number(df, "o_orderdate", ["o_orderkey"]).drop("o_orderdate")


EVENTS = "md5(concat_ws('|', event_id, '42'))"


@R.add(f"""WITH n AS (SELECT user_id AS g, count(*) AS n FROM events GROUP BY 1),
q AS (SELECT g, n, ceil(0.2 * (SELECT count(*) FROM events)) AS total,
        ceil(0.2 * (SELECT count(*) FROM events)) * n / (SELECT count(*) FROM events) AS exact FROM n),
s AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, g)
        <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM q)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {EVENTS}) <= take AS is_test
FROM events JOIN s ON g = user_id""")
def split_many_strata(spark, sf_dir):
    """Every user is a class."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    return splits.assign_test(df, ["event_id"], "user_id")


@R.add(f"""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {H}) - 1 AS i FROM orders),
c AS (SELECT o_custkey AS g, count(*) AS n, sum(count(*)) OVER (ORDER BY o_custkey) - count(*) AS start FROM orders GROUP BY 1),
f AS (SELECT g, fold, (SELECT count(*) FROM range(n::BIGINT) t(j) WHERE (start + j) % 4 = fold) AS size FROM c, range(4) k(fold)),
e AS (SELECT g, fold, sum(size) OVER (PARTITION BY g ORDER BY fold) AS hi, size FROM f)
SELECT o_orderkey, fold::INT AS fold FROM r JOIN e ON g = o_custkey AND i < hi AND i >= hi - size""")
def kfold_many_strata(spark, sf_dir):
    """Every customer is a class, some of a single order."""
    df = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    return splits.assign_folds(df, ["o_orderkey"], 4, "o_custkey").drop("o_custkey")
