"""Quantile regression: coverage, optimality against brute force, and the run around it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import quantile, train
from tablewright.plans.lineage import scratch_path
from tablewright.sources.models import load_run, save_run


@pytest.fixture(scope="module")
def spread(noise):
    """The spread grows with x, so levels have different slopes; g moves one group."""
    df = noise(3000, "x", "e").withColumn("g", F.when(F.col("id") % 3 == 0, "far").otherwise("near"))
    y = 2 * F.col("x") + (1 + 0.3 * (F.col("x") + 3)) * F.col("e") + F.when(F.col("g") == "far", 5.0).otherwise(0.0)
    return df.select("id", "x", "g", y.alias("y"))


def vectors(df, *columns):
    ready = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)
    return ready.select("_features", F.col("y").alias("_label")).persist()


def loss(y, f, level):
    return np.maximum(level * (y - f), (level - 1) * (y - f)).mean()


@pytest.mark.parametrize("level", [0.1, 0.5, 0.9])
def test_linear_fit_is_near_the_smallest_loss(spread, level):
    ready = vectors(spread.withColumn("far", (F.col("g") == "far").cast("double")), "x", "far")
    model = quantile.LinearQuantile(level).fit(ready)
    got = model.transform(ready).select("_label", "prediction").toPandas().to_numpy()
    assert abs((got[:, 0] <= got[:, 1]).mean() - level) < 0.01
    # at the optimum no feature tells on which side of the fit a row is
    data = np.array([[*r["_features"].toArray(), r["_label"]] for r in ready.collect()])
    x = np.c_[data[:, :2], np.ones(len(data))]
    best = np.r_[model.stages[0].coefficients.toArray(), 0.0]
    best[2] = np.quantile(data[:, 2] - x @ best, level)
    at = loss(data[:, 2], x @ best, level)
    for k in range(3):
        for move in (-0.05, 0.05):
            other = best.copy()
            other[k] += move
            assert loss(data[:, 2], x @ other, level) > at - 1e-4
    assert at == pytest.approx(loss(got[:, 0], got[:, 1], level), abs=1e-9)


def test_levels_do_not_share_a_slope(spread):
    ready = vectors(spread.where("g = 'near'"), "x")
    low, high = (quantile.LinearQuantile(q).fit(ready).stages[0].coefficients[0] for q in (0.1, 0.9))
    assert high - low > 0.5


def test_tree_leaves_are_group_quantiles(spread):
    df = spread.withColumn("far", (F.col("g") == "far").cast("double"))
    ready = vectors(df, "far")
    model = quantile.BoostedQuantile(0.8, rounds=1, rate=1.0, depth=1).fit(ready)
    got = {r["_features"][0]: r["p"] for r in model.transform(ready).groupBy("_features").agg(F.max("prediction").alias("p")).collect()}
    want = {r["far"]: r["q"] for r in df.groupBy("far").agg(F.percentile("y", 0.8).alias("q")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.05 for k in want)


def test_constant_feature_gives_the_plain_quantile(spread):
    ready = vectors(spread.withColumn("one", F.lit(1.0)), "one")
    want = ready.agg(F.percentile("_label", 0.3)).first()[0]
    for model in (quantile.LinearQuantile(0.3), quantile.BoostedQuantile(0.3, rounds=2)):
        assert model.fit(ready).transform(ready).first()["prediction"] == pytest.approx(want, abs=1e-9)


def test_equal_labels(spread):
    ready = vectors(spread.withColumn("y", F.lit(4.0)), "x")
    for model in (quantile.LinearQuantile(0.3), quantile.BoostedQuantile(0.3, rounds=2)):
        assert model.fit(ready).transform(ready).first()["prediction"] == pytest.approx(4.0)


def test_quantile_run(spread, spark):
    run, board = train.fit(spread, "y", ["id"], forced_type="quantile", quantile_level=0.9, blend=False, quick=True)
    assert run.kind == "quantile" and run.metric == "pinball_loss" and run.info()["quantile_level"] == 0.9
    ranked = board.collect()
    assert {r["model"] for r in ranked} == {"Linear", "GradientBoosting", "DecisionTree"}
    assert all(r["score_val"] < 0 for r in ranked)
    scored = run.score(spread)
    row = quantile.quantile_scores(scored, "y", "y_predicted", 0.9).first()
    assert abs(row["coverage"] - 0.9) < 0.02 and row["rows"] == 3000
    assert run.evaluate(spread)["pinball_loss"] == pytest.approx(row["pinball_loss"])
    top = train.feature_importance(run, spread, ["id"]).collect()
    assert {r["feature"] for r in top} == {"x", "g"} and top[0]["importance"] > 0
    path = scratch_path(spark, "quantile-run")
    save_run(spark, run, path)
    again = load_run(spark, path)
    assert again.level == 0.9 and again.evaluate(spread) == pytest.approx(run.evaluate(spread))


def test_wrong_levels_and_labels(spread):
    for level in (0, 1, 1.5):
        with pytest.raises(ValueError, match="between 0 and 1"):
            train.fit(spread, "y", ["id"], forced_type="quantile", quantile_level=level)
    with pytest.raises(ValueError, match="need a number"):
        train.fit(spread, "g", ["id"], forced_type="quantile")
    with pytest.raises(ValueError, match="not a metric"):
        train.fit(spread, "y", ["id"], forced_type="regression", eval_metric="pinball_loss")


def test_scores_leave_out_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, 1.0), ("a", float("nan"), 0.0)], "k string, y double, f double")
    rows = quantile.quantile_scores(df, "y", "f", 0.25, ["k"]).collect()
    assert [(r["k"], r["pinball_loss"], r["coverage"], r["rows"]) for r in rows] == [("a", 0.5, 0.5, 2)]
    none = quantile.quantile_scores(df.limit(0), "y", "f", 0.25).first()
    assert none["pinball_loss"] is None and none["rows"] == 0
