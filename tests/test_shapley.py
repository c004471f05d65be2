"""Closed-form Shapley values against every coalition, and fits with empty columns."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F
from tablewright.operators import explain, shapley, train

KEY = ["id"]
F_ = {"featuresCol": "_features", "labelCol": "_label"}


def spread(spark, rows, names):
    """Reproducible columns between 0 and 1."""
    return spark.range(rows).select("id", *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(10_007)) / 10_007.0).alias(n) for n in names])


@pytest.fixture(scope="module")
def eight(spark):
    df = spread(spark, 240, "abcdef").select(
        "*", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("g"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("h"),
    )
    made = F.col("a") * F.col("b") + F.when(F.col("g") == "x", 1.0).otherwise(0.0) + F.col("c") + F.dayofmonth("h") / 30.0
    return df.withColumn("y", made).coalesce(2).cache()


def by_key(table):
    return {(r["id"], r["feature"]): (r["shap_value"], r["prediction"], r["base_value"]) for r in table.collect()}


@pytest.mark.parametrize("name", ["tree", "forest", "boost", "linear"])
def test_equals_every_coalition_on_eight_features(spark, eight, name):
    made = {
        "tree": DecisionTreeRegressor(**F_, maxDepth=5, seed=1), "forest": RandomForestRegressor(**F_, numTrees=4, maxDepth=4, seed=1),
        "boost": GBTRegressor(**F_, maxIter=3, maxDepth=3, seed=1), "linear": LinearRegression(**F_, regParam=0.01),
    }
    run, _ = train.fit(eight, "y", KEY, estimators={name: made[name]}, blend=False)
    few, behind = eight.where("id < 4"), eight.where("id >= 200 AND id < 212")
    got = by_key(shapley.model_shapley(few, run, KEY, background=behind, most_patterns=40))
    want = by_key(explain.shapley_values(few, run.features, KEY, run.predict, background=behind, background_rows=100))
    assert set(got) == set(want) and len(got) == 32
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


@pytest.mark.parametrize("of_class", [None, "no"])
def test_probabilities_of_a_class_and_margins(spark, eight, of_class):
    df = eight.withColumn("y", F.when(F.col("y") > 1.4, "yes").otherwise("no"))
    forest = RandomForestClassifier(**F_, numTrees=3, maxDepth=4, seed=2)
    run, _ = train.fit(df, "y", KEY, estimators={"forest": forest}, blend=False)
    few, behind = df.where("id < 3"), df.where("id >= 100 AND id < 110")
    got = by_key(shapley.model_shapley(few, run, KEY, background=behind, of_class=of_class))
    chance = lambda t: run.predict(t, of_class=of_class)
    want = by_key(explain.shapley_values(few, run.features, KEY, chance, background=behind))
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k
    boost, _ = train.fit(df, "y", KEY, estimators={"boost": GBTClassifier(**F_, maxIter=2, maxDepth=3, seed=2)}, blend=False)
    margins = {r["id"]: r["prediction"] for r in shapley.model_shapley(few, boost, KEY, of_class=of_class).collect()}
    for r in boost.predict(few, of_class=of_class).collect():
        assert r["prediction"] == pytest.approx(1 / (1 + np.exp(-2 * margins[r["id"]])))


def test_forty_features_and_the_whole_table_as_background(spark):
    names = [f"x{i}" for i in range(40)]
    df = spread(spark, 600, names).withColumn("y", sum((F.col(n) * (i % 5) for i, n in enumerate(names)), F.lit(0.0))).coalesce(2).cache()
    run, _ = train.fit(df, "y", KEY, estimators={"forest": RandomForestRegressor(**F_, numTrees=5, maxDepth=5, seed=3)}, blend=False)
    table = shapley.model_shapley(df, run, KEY)
    sums = table.groupBy("id").agg(F.sum("shap_value").alias("s"), F.first("prediction").alias("p"), F.first("base_value").alias("b"), F.count("*").alias("n"))
    rows = sums.join(run.predict(df).select("id", "prediction"), "id").collect()
    assert len(rows) == 600 and all(r["n"] == 40 for r in rows)
    assert all(abs(r["s"] + r["b"] - r["p"]) < 1e-9 and abs(r["p"] - r["prediction"]) < 1e-9 for r in rows)
    assert rows[0]["b"] == pytest.approx(run.predict(df).agg(F.avg("prediction")).first()[0])


def test_a_column_without_values_is_left_out_of_the_fit(spark):
    df = spread(spark, 200, "a").select(
        "id", "a", F.lit(None).cast("double").alias("gone"), F.lit(float("nan")).alias("nan"), F.lit(None).cast("string").alias("word"),
        F.lit(None).cast("date").alias("day"), (F.col("a") * 2).alias("y"),
    ).cache()
    run, board = train.fit(df, "y", KEY, quick=True)
    assert run.features == ["a"] and run.score(df).count() == 200 and board.count() > 1
    with pytest.raises(ValueError, match="no usable feature"):
        train.fit(df.drop("a"), "y", KEY, quick=True)
