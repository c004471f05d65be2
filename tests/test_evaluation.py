from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import errors, evaluate


@pytest.fixture(scope="module")
def binary(spark):
    rows = [(0, 0, 0, 0.95, 0.05), (1, 0, 1, 0.1, 0.9), (2, 1, 1, 0.2, 0.8), (3, 1, 0, 0.4, 0.6), (4, 0, 0, 0.88, 0.12)]
    return spark.createDataFrame(rows, "id int, actual int, predicted int, prob_0 double, prob_1 double")


def test_confusion_and_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "z")], "actual string, predicted string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 1 and cells[("c", "c")] == 0
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert report["a"]["recall"] == 0.5 and report["z"]["support"] == 0 and report["z"]["f1"] == 0.0
    assert report["accuracy"]["precision"] == 0.5 and report["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    assert evaluate.confusion_wide(evaluate.confusion_matrix(df)).columns == ["actual", "a", "b", "c"]


def test_curves_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (0, 0.2), (0, 0.1)], "actual int, score double")
    table = evaluate.threshold_table(df, "actual", "score")
    roc = [(r["fpr"], r["tpr"], r["threshold"]) for r in evaluate.roc_curve(table).orderBy(F.desc("threshold")).collect()]
    # 0.3, 0.2 and 0.1 are one straight step each: only the last stays
    assert roc == [(0.0, 0.0, float("inf")), (0.0, 0.5, 0.9), (0.25, 1.0, 0.8), (1.0, 1.0, 0.1)]
    assert evaluate.roc_curve(table, drop_intermediate=False).count() == 6
    assert evaluate.roc_auc(table).first()[0] == pytest.approx(1 - 0.5 * 0.25 / 2 - 0.0, abs=1e-9)
    assert evaluate.average_precision(table).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    pr = evaluate.pr_curve(table).collect()
    assert len(pr) == 6 and [r for r in pr if r["threshold"] is None][0]["precision"] == 1.0


def test_auc_of_the_negated_score(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("actual"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)) / 40.0).alias("s"))
    a = evaluate.roc_auc(evaluate.threshold_table(df, "actual", "s")).first()[0]
    b = evaluate.roc_auc(evaluate.threshold_table(df.withColumn("s", -F.col("s")), "actual", "s")).first()[0]
    assert a + b == pytest.approx(1.0)


def test_bucketed_curve_equals_the_plain_one(spark):
    df = spark.range(800).select((F.col("id") % 3 == 0).cast("int").alias("actual"), (F.pmod(F.xxhash64("id"), F.lit(200)) / 200.0).alias("s"))
    plain = evaluate.threshold_table(df, "actual", "s", edges=[])
    cut = evaluate.threshold_table(df, "actual", "s", edges=[0.1, 0.25, 0.5, 0.9])
    assert sorted(plain.collect()) == sorted(cut.collect()) or sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_threshold_choice(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.7), (0, 0.6), (1, 0.4), (0, 0.1)], "actual int, score double")
    table = evaluate.threshold_table(df, "actual", "score")
    best = evaluate.calibrate_threshold(table, "f1").first()
    assert best["threshold"] == 0.4 and best["score"] == pytest.approx(6 / 7)
    assert evaluate.calibrate_threshold(table, "precision").first()["threshold"] == 0.9
    with pytest.raises(ValueError, match="not one of"):
        evaluate.calibrate_threshold(table, "nope")


def test_residuals(spark):
    perfect = spark.createDataFrame([(10.0, 10.0), (20.0, 20.0)], "actual double, predicted double")
    assert evaluate.residual_stats(perfect).first()["r2"] == 1.0
    flat = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "actual double, predicted double")
    row = evaluate.residual_stats(flat).first()
    assert row["r2"] == 0.0 and row["root_mean_squared_error"] == 1.0
    hist = evaluate.residual_histogram(perfect).orderBy("bin").collect()
    assert len(hist) == 50 and sum(r["n"] for r in hist) == 2 and hist[0]["bin_left"] == -0.5
    spread = spark.range(101).select(F.col("id").cast("double").alias("actual"), F.lit(0.0).alias("predicted"))
    counts = [r["n"] for r in evaluate.residual_histogram(spread).orderBy("bin").collect()]
    assert sum(counts) == 101 and counts[-1] == 3 and set(counts[:-1]) == {2}


def test_prediction_stats(spark):
    df = spark.createDataFrame([(10.0, 10.5), (20.0, 19.5), (30.0, 30.2)], "target double, p double")
    row = evaluate.prediction_stats(df, "p", "target").first()
    assert row["median"] == 19.5 and row["mean_absolute_error"] == pytest.approx(0.4)
    assert "r2" not in evaluate.prediction_stats(df.drop("target"), "p", "target").columns


def test_worst_and_best_classified(binary):
    worst = errors.ranked_predictions(binary, 3).collect()
    assert [r["id"] for r in worst[:2]] == [3, 1] and [r["is_error"] for r in worst] == [True, True, False]
    assert worst[0]["confidence"] == 0.4 and worst[0]["top2_margin"] == 0.2
    best = errors.ranked_predictions(binary, 2, worst=False).collect()
    assert [r["id"] for r in best] == [0, 4]
    summary = errors.error_summary(binary).first()
    assert (summary["error_count"], summary["error_rate"]) == (2, 0.4)


def test_class_key_forms(spark):
    whole = spark.createDataFrame([(1.0, 1.0, 0.2, 0.8)], "actual double, predicted double, prob_0 double, prob_1 double")
    assert errors.with_confidence(whole).first()["confidence"] == 0.8
    flags = spark.createDataFrame([(True, False, 0.3, 0.7)], "actual boolean, predicted boolean, prob_True double, prob_False double")
    row = errors.with_confidence(flags).first()
    assert row["confidence"] == 0.7 and row["is_error"]
    other = spark.createDataFrame([("a", "q", 0.5)], "actual string, predicted string, prob_a double")
    assert errors.with_confidence(other).first()["confidence"] is None


def test_error_hints(spark):
    sure = spark.createDataFrame([(0, 1, 0.05, 0.95)] * 3 + [(0, 0, 0.9, 0.1), (1, 1, 0.1, 0.9)], "actual int, predicted int, prob_0 double, prob_1 double")
    assert "confident_errors" in {r["code"] for r in errors.error_hints(sure).collect()}
    skewed = spark.createDataFrame([(0, 0, 0.9, 0.1)] * 8 + [(1, 0, 0.6, 0.4)] * 2, "actual int, predicted int, prob_0 double, prob_1 double")
    assert [r["hint"].split()[1] for r in errors.error_hints(skewed).where("code = 'overrepresented_class'").collect()] == ["1"]
    close = spark.createDataFrame([("a", "b", 0.33, 0.35, 0.32)] * 5, "actual string, predicted string, prob_a double, prob_b double, prob_c double")
    assert "close_calls" in {r["code"] for r in errors.error_hints(close).collect()}


def test_regression_errors(spark):
    df = spark.createDataFrame([(100.0, 105.0), (200.0, 250.0), (300.0, 310.0), (400.0, 250.0), (0.0, 2.0)], "actual double, predicted double")
    worst = errors.ranked_residuals(df, 2).collect()
    assert [r["abs_residual"] for r in worst] == [150.0, 50.0] and worst[0]["residual_pct"] == 37.5
    assert errors.with_residuals(df).where("actual = 0").first()["residual_pct"] is None
    biased = spark.range(30).select((F.col("id") * 10.0).alias("actual"), (F.col("id") * 10.0 - 100).alias("predicted"))
    row = errors.residual_summary(biased).first()
    assert row["bias"] == "under-predicting" and not row["heteroscedastic"]
    wide = spark.range(1, 40).select(F.col("id").cast("double").alias("actual"), (F.col("id") * (1 + (F.col("id") % 2 * 2 - 1) * 0.1)).alias("predicted"))
    assert errors.residual_summary(wide).first()["heteroscedastic"]


def test_join_needs_matching_keys(spark):
    p = spark.createDataFrame([(1, 0), (2, 1)], "id int, actual int")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string")
    assert errors.join_predictions(p, t, ["id"]).count() == 2
    with pytest.raises(ValueError, match="mismatch"):
        errors.join_predictions(p, t.limit(1), ["id"])
    with pytest.raises(ValueError, match="pair up"):
        errors.join_predictions(p, spark.createDataFrame([(1, "a"), (3, "b")], "id int, f string"), ["id"])


def test_flag(binary):
    flagged = errors.flag_low_confidence(errors.with_confidence(binary), 0.5)
    assert flagged.where("flagged_low_confidence").count() == 1
    assert errors.flag_low_confidence(binary, 0.5).columns == binary.columns
