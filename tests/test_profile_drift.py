from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import correlation, drift, profile
from tablewright.sources.readers import read_csv


def by(df, key="feature"):
    return {r[key]: r for r in df.collect()}


def test_overview_counts_repeats_and_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (1, None), (None, "1")], "x int, s string")
    row = profile.overview(df).first()
    assert (row["rows"], row["columns"], row["duplicate_rows"]) == (6, 2, 2)
    assert row["dtype_breakdown"] == {"int": 1, "string": 1}
    assert profile.duplicate_rows(df, suspect_groups=0) == 2


def test_missing(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, "b"), (3.0, None, "c"), (4.0, 1.0, "d"), (5.0, 2.0, "e")], "a double, b double, c string")
    got = by(profile.missing_values(df))
    assert (got["a"]["missing_count"], got["b"]["missing_pct"], got["c"]["missing_pct"]) == (1, 60.0, 20.0)
    total = profile.missing_totals(profile.missing_values(df)).first()
    assert tuple(total) == (5, 3)
    flags = {(r["feature"], r["flag"]) for r in profile.quality_flags(df, None).collect()}
    assert ("b", "high_missing") in flags


def test_nan_is_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y\n1.5,a\nNaN,b\n,c\n")
    df = read_csv(spark, str(tmp_path / "t.csv"), "x double, y string")
    assert by(profile.missing_values(df))["x"]["missing_count"] == 2


def test_outliers_and_moments(spark):
    df = spark.createDataFrame([(1.0,)] * 98 + [(1000.0,), (-1000.0,)], "x double")
    r = profile.numeric_profile(df, "x").first()
    assert r["outlier_count"] == 2 and r["outlier_pct"] == 2.0 and r["is_label"]
    small = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double")
    r = profile.numeric_profile(small).first()
    assert r["skew"] == pytest.approx(1.6523, abs=1e-4) and r["kurtosis"] is None
    assert r["q25"] == 1.5 and r["q75"] == 6.0


def test_boolean_is_not_numeric(spark):
    df = spark.createDataFrame([(True, 1), (False, 2)], "b boolean, n int")
    assert profile.numeric_columns(df) == ["n"] and profile.categorical_columns(df) == ["b"]


def test_categorical_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    r = profile.categorical_profile(df).first()
    assert (r["nunique"], r["missing_count"], r["top_value"], r["top_value_count"], r["top_value_pct"]) == (2, 1, "a", 2, 40.0)
    empty = profile.categorical_profile(spark.createDataFrame([(1,)], "x int"))
    assert empty.count() == 0


def test_label_profiles(spark):
    df = spark.range(100).select((F.col("id") < 80).cast("int").alias("y"), F.col("id").cast("double").alias("r"))
    row = profile.label_summary(df, "y").first()
    assert row["type"] == "classification" and row["imbalance_ratio"] == 4.0 and row["class_counts"] == {"0": 20, "1": 80}
    reg = profile.label_summary(df, "r").first()
    assert reg["type"] == "regression" and reg["median"] == 49.5 and reg["nunique"] == 100
    assert "not found" in profile.label_summary(df, "nope").first()["error"]


def test_deep_profile(noise):
    df = noise(500, "a").select(
        F.exp(2 * F.col("a")).alias("skewed"), F.col("a").alias("target"),
        (F.col("id") % 3).cast("string").alias("low"), F.concat(F.lit("u"), F.col("id") % 300).alias("high"),
        F.concat(F.lit("m"), F.col("id") % 50).alias("medium"), F.lit("x").alias("fixed"),
    )
    table = profile.deep_profile(df, "target")
    assert profile.suggested_transforms(table) == {"log": ["skewed"], "onehot": ["low"]}
    got = by(table)
    assert "300 values" in got["high"]["recommendation"] and "50 values" in got["medium"]["recommendation"]
    assert "one value only" in got["fixed"]["recommendation"]


def test_correlation_and_drop_advice(noise):
    df = noise(400, "x", "n", "c").select(
        F.col("x").alias("feat_a"), (F.col("x") + 0.01 * F.col("n")).alias("feat_b"), F.col("c").alias("feat_c"),
        (F.col("x") > 0).cast("int").alias("target"),
    )
    corr = correlation.correlation_long(df, "target")
    pairs = correlation.correlated_pairs(corr).collect()
    assert [(p["feature_a"], p["feature_b"]) for p in pairs] == [("feat_a", "feat_b")]
    advice = correlation.drop_recommendations(corr, "target").collect()
    assert len(advice) == 1 and {advice[0]["feature"], advice[0]["correlated_with"]} == {"feat_a", "feat_b"}


def test_constant_columns_never_correlate(spark):
    df = spark.range(10).select(F.lit(5.0).alias("const"), F.col("id").cast("double").alias("vary"), F.col("id").alias("same"))
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in correlation.correlation_long(df).collect()}
    assert got[("const", "vary")] is None and got[("vary", "same")] == pytest.approx(1.0)
    assert correlation.drop_recommendations(correlation.correlation_long(df.drop("const"), "same"), "same").count() == 0


def test_wide_correlation_takes_the_matrix_path(noise, monkeypatch):
    df = noise(200, "a", "b", "c").select("a", "b", F.when(F.col("id") % 5 > 0, F.col("c")).alias("c"))
    narrow = correlation.correlation_long(df).orderBy("pair").collect()
    monkeypatch.setattr(correlation, "WIDE", 2)
    wide = correlation.correlation_long(df).orderBy("pair").collect()
    for x, y in zip(narrow, wide, strict=True):
        assert x["correlation"] == pytest.approx(y["correlation"]) and x["n"] == y["n"]


@pytest.fixture(scope="module")
def sides(noise):
    train = noise(2000, "feat_a", "feat_b").withColumns({"cat": F.lit("x"), "target": F.lit(1)})
    shifted = noise(800, "feat_a", "feat_b").withColumns({"feat_a": F.col("feat_a") + 5, "cat": F.lit("x"), "target": F.lit(0)})
    return train, shifted


def test_drift_report(sides):
    train, shifted = sides
    rows = drift.detect_drift(train, shifted, "target", ["id"]).collect()
    assert [r["feature"] for r in rows] == ["feat_a", "feat_b"]
    assert rows[0]["status"] == "significant_drift" and rows[1]["status"] == "no_drift"
    same = drift.detect_drift(train, train, "target", ["id"])
    assert {r["psi"] for r in same.collect()} == {0.0}
    summary = drift.drift_summary(drift.detect_drift(train, shifted, "target", ["id"])).first()
    assert (summary["features_checked"], summary["significant_drift"], summary["drifted_features"]) == (2, 1, ["feat_a"])


def test_drift_edge_cases(spark):
    train = spark.range(100).select(F.lit(3.0).alias("const"), F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("empty"))
    far = spark.range(10).select(F.lit(4.0).alias("const"), (F.col("id") + 1000.0).alias("x"), F.lit(1.0).alias("empty"))
    got = by(drift.detect_drift(train, far))
    assert set(got) == {"const", "x"}
    assert got["const"]["psi"] == 0.0 and got["const"]["status"] == "no_drift"
    assert got["x"]["psi"] is None and got["x"]["status"] == "significant_drift" and got["x"]["out_of_range_pct"] == 100.0
    assert drift.detect_drift(train.select("x"), far.select("const")).count() == 0


def test_psi_by_hand(spark):
    train = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    other = spark.createDataFrame([(0.0,), (8.9,), (9.0,), (50.0,)], "x double")
    row = drift.detect_drift(train, other).first()
    # edges 0, .9, 1.8 ... 9: one value per bin; the three in range fall into the first and last bins
    expected = [0.1] * 10
    actual = [1 / 3] + [1e-6] * 8 + [2 / 3]
    assert row["psi"] == pytest.approx(sum((a - e) * math.log(a / e) for a, e in zip(actual, expected, strict=True)), abs=1e-6)
    assert row["in_range_rows"] == 3 and row["out_of_range_pct"] == 25.0


def test_nan_is_missing_at_every_size(spark):
    from tablewright.plans.selection import exact_quantiles

    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN double('NaN') ELSE cast(id as double) END AS x")
    small = exact_quantiles(df, ["x"], [0.25, 0.5])["x"]
    large = exact_quantiles(df, ["x"], [0.25, 0.5], builtin_rows=0, exact_rows=100)["x"]
    assert small == large and small[1] == 1500.0
    row = profile.numeric_profile(df.withColumn("y", F.lit(1)), "y").first()
    assert row["missing"] == 300 if "missing" in row.asDict() else row["missing_pct"] == 10.0
    assert row["max"] == 2999.0 and row["mean"] == row["mean"]
