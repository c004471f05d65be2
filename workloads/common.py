"""Tables and formula-scored frames the queries share, with the same frames in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries by name; ``sql`` is the DuckDB text or None for a rows-only check."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(fn: Query) -> Query:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"query '{key}' is registered twice")
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return keep


def rounded(df: DataFrame, digits: int = 4, columns: list[str] | None = None) -> DataFrame:
    """Round double columns, so that summation order cannot show."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# A binary score with ties, its 0/1 truth and its 0.5-cutoff decision, from lineitem.
BINARY_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, actual, score,
       CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted,
       round(1 - score, 6) AS prob_0, score AS prob_1
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual,
             round(1 / (1 + exp(-((l_quantity - 25) / 10 + (l_extendedprice - 50000) / 40000))), 6) AS score
      FROM lineitem)
"""

# Three classes; the decision is a formula over the row, unrelated to the truth.
MULTI_SQL = """
SELECT actual, predicted, prob_A, prob_N, prob_R, l_orderkey, l_linenumber, l_extendedprice
FROM (SELECT *, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS predicted,
             round(a / (a + n + r), 6) AS prob_A, round(n / (a + n + r), 6) AS prob_N,
             round(r / (a + n + r), 6) AS prob_R
      FROM (SELECT *, l_returnflag AS actual, l_quantity AS a, l_extendedprice / 2000 AS n,
                   25 + l_discount * 100 AS r FROM lineitem))
"""

# A regression prediction for the line price.
REGRESSION_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice AS actual,
       900 * l_quantity + 25000 AS predicted,
       l_extendedprice - (900 * l_quantity + 25000) AS residual
FROM lineitem
"""


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("l_quantity") - 25) / 10 + (F.col("l_extendedprice") - 50000) / 40000
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            (F.col("l_returnflag") == "R").cast("int").alias("actual"),
            F.round(1 / (1 + F.exp(-z)), 6).alias("score"),
        )
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumns({"prob_0": F.round(1 - F.col("score"), 6), "prob_1": F.col("score")})
    )


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n, r = F.col("l_quantity"), F.col("l_extendedprice") / 2000, 25 + F.col("l_discount") * 100
    pick = F.when((a >= n) & (a >= r), "A").when(n >= r, "N").otherwise("R")
    total = a + n + r
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("actual"),
        pick.alias("predicted"),
        F.round(a / total, 6).alias("prob_A"),
        F.round(n / total, 6).alias("prob_N"),
        F.round(r / total, 6).alias("prob_R"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


def scored_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = 900 * F.col("l_quantity") + 25000
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.col("l_extendedprice").alias("actual"),
        predicted.alias("predicted"),
        (F.col("l_extendedprice") - predicted).alias("residual"),
    )
