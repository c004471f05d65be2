from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import evaluate, explain, leakage, report

KEY = ["id"]


def scores(df, label, **options):
    return {r["feature"]: r["score"] for r in leakage.leakage_scores(df, label, KEY, **options).collect()}


def test_planted_copy_is_found(noise):
    df = noise(600, "a", "t").select(
        "id", "a", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("b"),
        (F.col("t") > 0).cast("int").alias("target"), (F.col("t") > 0).cast("int").alias("leak"),
        F.when(F.col("t") > 0, "yes").otherwise("no").alias("word"),
        (F.col("t") > 0).alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("t") > 0, 100).otherwise(0)).alias("day"),
    )
    got = scores(df, "target")
    assert all(got[c] == 1.0 for c in ("leak", "word", "flag", "day"))
    assert abs(got["a"] - 0.5) < 0.1 and abs(got["b"] - 0.5) < 0.1
    verdicts = leakage.leakage_verdicts(leakage.leakage_scores(df, "target", KEY))
    hints = leakage.leakage_hints(verdicts).first()
    assert hints["suspects"] == 4 and hints["drop_list"] == ["day", "flag", "leak", "word"]
    assert "perfect" in verdicts.where("feature = 'leak'").first()["reason"]


def test_regression_proxy_and_order_only_text(noise):
    df = noise(900, "t", "e", "a").select(
        "id", "a", (100 * F.col("t") + 500).alias("target"),
        (F.log(100 * F.col("t") + 501) + F.col("e") / 1000).alias("proxy"),
        F.format_string("%08.1f", 100 * F.col("t") + 500).alias("padded"),
    )
    got = scores(df, "target")
    assert got["proxy"] > 0.9 and got["padded"] > 0.9 and got["a"] < 0.1


def test_nulls_and_short_columns(noise):
    df = noise(300, "a").select(
        "id", "a", F.lit(None).cast("double").alias("empty"), F.when(F.col("id") < 5, F.col("a")).alias("short"),
        F.when(F.col("id") % 10 > 0, (F.col("a") > 0).cast("int")).alias("target"),
    )
    table = leakage.leakage_scores(df, "target", KEY).collect()
    assert [r["feature"] for r in table] == ["a"] and table[0]["rows"] == 270 and table[0]["score"] > 0.98


def brute_tree(x, y, depth):
    """Best split by Gini over every threshold, as a prediction function."""
    values, counts = np.unique(y, return_counts=True)
    vote = values[counts.argmax()]
    xs = np.unique(x)
    if depth == 0 or len(values) == 1 or len(xs) == 1:
        return lambda q: vote

    def gini(part):
        return len(part) - sum(c * c for c in np.unique(part, return_counts=True)[1]) / len(part)

    cuts = [(a + b) / 2 for a, b in zip(xs, xs[1:], strict=False)]
    best = min(cuts, key=lambda c: gini(y[x <= c]) + gini(y[x > c]))
    low, high = brute_tree(x[x <= best], y[x <= best], depth - 1), brute_tree(x[x > best], y[x > best], depth - 1)
    return lambda q: low(q) if q <= best else high(q)


def test_histogram_tree_equals_a_plain_tree():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 400)
    y = ((x > 10) & (x < 25) ^ (rng.random(400) < 0.1)).astype(int)
    table = np.zeros((40, 2))
    np.add.at(table, (x, y), 1)
    got = leakage.fit_histogram_tree(table, 3, True)
    tree = brute_tree(x, y, 3)
    assert [got[v] for v in np.unique(x)] == [tree(v) for v in np.unique(x)]
    held = np.array([[5.0, 0], [1, 4]])
    assert leakage.fold_score(np.array([0.0, 1.0]), held, True) == pytest.approx((5 / 6 + 1) / 2)


def linear(df):
    return df.withColumn("prediction", 2.0 * F.col("a") - 3.0 * F.col("b") + F.col("a") * F.col("c"))


@pytest.fixture(scope="module")
def frame(noise):
    return noise(120, "a", "b", "c").withColumn("truth", 2.0 * F.col("a") - 3.0 * F.col("b"))


def test_shapley_values_equal_all_orderings(frame):
    table = explain.shapley_values(frame, ["a", "b", "c"], KEY, linear, background_rows=10, max_rows=30)
    got = {(r["id"], r["feature"]): r["shap_value"] for r in table.collect()}
    assert len(got) == 90
    rows = {r["id"]: r for r in frame.collect()}
    base = [r.asDict() for r in explain.hash_sample(frame, KEY, 10).collect()]

    def f(v):
        return 2 * v["a"] - 3 * v["b"] + v["a"] * v["c"]

    for i in sorted({k[0] for k in got})[:5]:
        expected = dict.fromkeys("abc", 0.0)
        for order in permutations("abc"):
            for b in base:
                v = {k: b[k] for k in "abc"}
                for name in order:
                    before = f(v)
                    v[name] = rows[i][name]
                    expected[name] += (f(v) - before) / 60
        for name in "abc":
            assert got[(i, name)] == pytest.approx(expected[name])


def test_shapley_orderings_add_up(frame, monkeypatch):
    monkeypatch.setattr(explain, "EXACT_FEATURES", 2)
    table = explain.shapley_values(frame, ["a", "b", "c"], KEY, linear, background_rows=5, max_rows=None, permutations=3)
    total = table.groupBy("id").agg(
        (F.sum("shap_value") + F.first("base_value") - F.first("prediction")).alias("gap"), F.count("*").alias("n")
    )
    rows = total.collect()
    assert len(rows) == 120 and max(abs(r["gap"]) for r in rows) < 1e-9 and {r["n"] for r in rows} == {3}


def counted(spark):
    """``linear`` that counts the rows it scores."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        scored.add(1)
        return x

    return scored, lambda df: linear(df).withColumn("prediction", seen("prediction"))


def test_shapley_copies_are_not_sorted(frame):
    named = frame.withColumn("t", F.concat(F.lit("t"), F.col("id")))
    table = explain.shapley_values(named, ["a", "b", "c", "t"], KEY, linear, background_rows=3)
    assert "SortAggregate" not in table._jdf.queryExecution().executedPlan().toString()
    shown = {r["id"]: r["feature_value"] for r in table.where("feature = 't'").collect()}
    assert shown == {i: f"t{i}" for i in range(120)}


def test_interactions_score_the_copies_once(spark, frame):
    scored, predict = counted(spark)
    shap = explain.shapley_values(frame, ["a", "b", "c"], KEY, predict, background_rows=4)
    pairs = explain.shap_interactions(shap, KEY, 3)
    assert {(r["feature_a"], r["feature_b"]) for r in pairs.collect()} == {("b", "a"), ("b", "c"), ("a", "c")}
    assert scored.value == 120 * 4 * 8
    assert not shap.select("id", "feature", "shap_value").storageLevel.useMemory


def test_metadata_scores_the_copies_once(spark, frame):
    scored, predict = counted(spark)
    shap = explain.shapley_values(frame, ["a", "b", "c"], KEY, predict, background_rows=4)
    meta = report.explanation_tables(shap, KEY, ["a", "b", "c"])["metadata"].first()
    assert (meta["n_rows"], meta["n_features"], meta["top_features"]) == (120, 3, ["b", "a", "c"])
    assert scored.value == 120 * 4 * 8


def test_shap_tables(spark):
    rows = [(i, f, v * (1 + i), "x") for i in range(4) for f, v in [("a", 3.0), ("b", -2.0), ("c", 0.5)]]
    shap = spark.createDataFrame(rows, "id int, feature string, shap_value double, feature_value string")
    summary = explain.shap_summary(shap).orderBy("rank").collect()
    assert [(r["feature"], r["mean_abs_shap"]) for r in summary] == [("a", 7.5), ("b", 5.0), ("c", 1.25)]
    top = explain.shap_top_features(shap, KEY, 2).where("id = 0").first()["top_features"]
    assert [(t["feature"], t["shap_value"]) for t in top] == [("a", 3.0), ("b", -2.0)]
    pairs = explain.shap_interactions(shap, KEY, 2).collect()
    assert len(pairs) == 1 and pairs[0]["corr"] == -1.0 and "opposed" in pairs[0]["hint"]
    assert explain.shap_interactions(shap, KEY, 1).count() == 0
    both = shap.withColumn("class", F.lit("p")).unionByName(shap.withColumns({"class": F.lit("q"), "shap_value": -F.col("shap_value")}))
    assert explain.shap_summary(both).where("feature = 'a'").first()["mean_abs_shap"] == 7.5
    assert explain.shap_wide(shap, KEY, ["a", "b"]).columns == ["id", "a", "b"]


def test_permutation_importance(frame, monkeypatch):
    def plain(df):
        return df.withColumn("prediction", 2.0 * F.col("a") - 3.0 * F.col("b"))

    score = -F.sqrt(F.avg((F.col("prediction") - F.col("truth")) ** 2))
    got = {r["feature"]: r for r in explain.permutation_importance(frame, ["a", "b", "c"], KEY, plain, score, repeats=2).collect()}
    assert got["b"]["importance"] > got["a"]["importance"] > 0 and got["c"]["importance"] == 0.0 and got["a"]["stddev"] > 0
    monkeypatch.setattr(explain, "BUCKET_ROWS", 13)
    donors = explain.shuffle_within_buckets(frame, ["a", "b"], KEY, 1, 120)
    own = sorted(r["a"] for r in frame.collect())
    assert sorted(r["_donor"]["a"] for r in donors.collect()) == own  # a permutation: no value lost


def test_partial_dependence(spark):
    df = spark.range(51).select("id", (F.col("id") * 2).alias("num"), F.when(F.col("id") < 30, "a").otherwise("b").alias("cat"))

    def model(x):
        return x.withColumn("prediction", F.col("num") + F.when(F.col("cat") == "a", 10).otherwise(0))

    curves = explain.partial_dependence(df, model, ["num", "cat"], KEY)
    num = curves.where("is_numeric").orderBy("position").collect()
    assert len(num) == 20 and float(num[0]["grid"]) == 0.0 and float(num[-1]["grid"]) == 100.0
    cat = {r["grid"]: r["pdp"] for r in curves.where("NOT is_numeric").collect()}
    assert cat["a"] - cat["b"] == pytest.approx(10)
    shapes = explain.pdp_shapes(curves).collect()
    assert [(r["feature"], r["shape"]) for r in shapes] == [("num", "increasing")]
    with pytest.raises(ValueError, match="missing columns"):
        explain.partial_dependence(df, model, ["nope"], KEY)


def test_pdp_shapes(spark):
    lines = {"up": [0, 1, 1], "down": [3, 2, 0], "peak": [0, 1, 0], "flat_peak": [0, 0.01, 0], "short": [0, 1]}
    rows = [(f, i, True, str(i), float(v)) for f, vs in lines.items() for i, v in enumerate(vs)]
    curves = spark.createDataFrame(rows, "feature string, position int, is_numeric boolean, grid string, pdp double")
    got = {r["feature"]: r["shape"] for r in explain.pdp_shapes(curves).collect()}
    assert got == {"up": "increasing", "down": "decreasing", "peak": "non-monotonic", "flat_peak": None}


def test_shapley_values_of_more_than_sixty_features(spark):
    names = [f"x{i}" for i in range(70)]
    df = spark.range(6).select("id", *[((F.col("id") * (i + 3)) % 7).cast("double").alias(n) for i, n in enumerate(names)])

    def predict(t):
        return t.withColumn("prediction", sum((F.col(n) * (i % 5) for i, n in enumerate(names)), F.lit(0.0)))

    table = explain.shapley_values(df, names, ["id"], predict, background_rows=3, permutations=2)
    assert {r.method for r in table.select("method").distinct().collect()} == {"sampled"}
    gaps = table.groupBy("id").agg((F.sum("shap_value") + F.first("base_value") - F.first("prediction")).alias("gap"))
    assert all(abs(r.gap) < 1e-6 for r in gaps.collect())


def test_dependence_on_a_column_without_values(spark):
    df = spark.range(5).selectExpr("id", "cast(NULL as double) AS empty", "cast(id as double) AS x")
    out = explain.partial_dependence(df, lambda t: t.withColumn("prediction", F.col("x")), ["empty", "x"], ["id"], n_values=3)
    assert {r.feature for r in out.collect()} == {"x"}


@pytest.mark.parametrize("edges", [[], [-0.5, 0.0, 0.5]])
def test_auc_by_group_counts_ties_half(noise, edges):
    df = noise(600, "x").select(
        F.concat(F.lit("g"), F.col("id") % 3).alias("g"), (F.col("x") > 0.1 * (F.col("id") % 7)).alias("hit"),
        F.when(F.col("id") % 3 == 2, 0.5).when(F.col("id") % 50 == 0, None).otherwise(F.round("x", 1)).alias("s"),
    )
    df = df.where("g <> 'g1' OR hit")  # one class only
    got = {r["g"]: r["roc_auc"] for r in evaluate.roc_auc_by(df, "hit", "s", True, ["g"], edges).collect()}
    rows = [r for r in df.collect() if r["s"] is not None]
    assert got["g1"] is None and got["g2"] == pytest.approx(0.5)
    pairs = [
        (a["s"] > b["s"]) + (a["s"] == b["s"]) / 2 for a in rows for b in rows if a["g"] == b["g"] == "g0" and a["hit"] and not b["hit"]
    ]
    assert got["g0"] == pytest.approx(sum(pairs) / len(pairs))
