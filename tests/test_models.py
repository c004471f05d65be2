from __future__ import annotations

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.operators import explain, report, splits, train
from tablewright.plans.lineage import scratch_path
from tablewright.sources.models import load_run, save_run
from tablewright.streaming import monitor

KEY = ["id"]


def tree():
    return {"DecisionTree": DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=3)}


@pytest.fixture(scope="module")
def three(noise):
    """Three text classes set by one feature, with a gap and a text feature."""
    return noise(400, "a", "b").select(
        "id", F.when(F.col("id") % 17 > 0, F.col("a")).alias("a"), "b", F.concat(F.lit("c"), F.col("id") % 4).alias("c"),
        F.when(F.col("a") < -0.4, "low").when(F.col("a") < 0.4, "mid").otherwise("top").alias("y"),
    )


def test_multiclass_run(three):
    fit_on, test = splits.train_test_split(three, "y", KEY)
    run, board = train.fit(fit_on, "y", KEY, estimators=tree() | {"Again": tree()["DecisionTree"]}, quick=True)
    assert run.kind == "multiclass" and run.classes == ["low", "mid", "top"] and board.count() == 3
    scored = run.score(test, min_confidence=0.6)
    assert {"prob_low", "prob_mid", "prob_top", "y_predicted", "confidence", "flagged_low_confidence"} <= set(scored.columns)
    bad = scored.where("abs(prob_low + prob_mid + prob_top - 1) > 1e-9 OR confidence < greatest(prob_low, prob_mid, prob_top)")
    assert bad.count() == 0 and run.evaluate(test)["accuracy"] > 0.85
    tested = train.test_leaderboard(run, board, test).collect()
    assert {r["model"] for r in tested} == {"DecisionTree", "Again", "Blend"} and tested[0]["score_test"] > 0.85
    importance = train.feature_importance(run, test, KEY).collect()
    assert importance[0]["feature"] == "a"
    info = run.info()
    assert info["problem_type"] == "multiclass" and info["features"] == ["a", "b", "c"]


def test_binary_threshold_and_metrics(three):
    df = three.withColumn("y", (F.col("y") == "top").cast("int"))
    run, _ = train.fit(df, "y", KEY, estimators=tree(), blend=False, calibrate="recall", eval_metric="roc_auc")
    assert run.kind == "binary" and run.threshold is not None
    everything = run.score(df, decision_threshold=0.0)
    assert everything.where("y_predicted = 0").count() == 0
    scores = run.evaluate(df)
    assert set(scores) == set(train.BINARY_METRICS) and 0.9 < scores["roc_auc"] <= 1.0
    summary = train.scoring_summary(run, df.drop("y")).first()
    assert summary["has_ground_truth"] is False and summary["eval_scores"] is None


def test_regression_and_auto_drop(noise):
    df = noise(300, "x", "n").select("id", "x", "n", (2.5 * F.col("x")).alias("y"))
    ols = {"Linear": LinearRegression(featuresCol="_features", labelCol="_label", solver="normal")}
    fit_on, test = splits.train_test_split(df, "y", KEY, stratify=False)
    results = train.train_with_auto_drop(fit_on, test, "y", KEY, estimators=ols, blend=False)
    assert [r["run"].features for r in results] == [["x", "n"], ["x"]] and results[1]["dropped"] == ["n"]
    assert results[0]["test_scores"]["r2"] == pytest.approx(1.0)
    out = train.improve_until(lambda drops: (fit_on.drop(*drops), test.drop(*drops)), "y", KEY, "r2", 0.99, 3, configurations=[{"estimators": ols, "blend": False}])
    assert out["reached"] and len(out["history"]) == 1
    with pytest.raises(ValueError, match="not among the scores"):
        train.improve_until(lambda drops: (fit_on, test), "y", KEY, "nope", 1, configurations=[{"estimators": ols, "blend": False}])


def test_choices_are_checked(three):
    with pytest.raises(ValueError, match="not supported"):
        train.tune_family(three, "y", KEY, "NN_TORCH")
    with pytest.raises(ValueError, match="not a metric"):
        train.fit(three, "y", KEY, eval_metric="r2")
    with pytest.raises(ValueError, match="Unsupported"):
        train.problem_type(three, "y", "ranking")
    assert train.problem_type(three, "id") == "regression"
    assert len(train.search_space("XT", "multiclass", 5)) == 5


def test_near_unique_text_is_hashed(three, monkeypatch):
    monkeypatch.setattr(train, "MAX_INDEXED_CATEGORIES", 3)
    stages = [type(s).__name__ for s in train.preparation(three, ["a", "c"])]
    assert "FeatureHasher" in stages and "StringIndexer" not in stages


def test_streaming_score_and_drift(spark, noise, tmp_path):
    df = noise(400, "v").select("id", "v", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"))
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    profile = monitor.training_profile(df.where("id < 200"), ["v"])
    stream = spark.readStream.schema(df.schema).parquet(source)
    out = scratch_path(spark, "out")
    query = monitor.start_drift_monitor(stream, "ts", profile, "5 days", scratch_path(spark, "state"), "1 day", lambda b, _: b.write.mode("overwrite").parquet(out), "complete")
    query.processAllAvailable()
    query.stop()
    batch = monitor.drift_by_window(df, "ts", profile, "5 days")
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    sliding = monitor.drift_by_window(df, "ts", profile, "4 days", "2 days")
    assert sliding.count() > batch.count()
    scored = monitor.score_stream(df, lambda x: x.withColumn("confidence", F.lit(0.4)), 0.5)
    assert scored.where("flagged_low_confidence").count() == 400


def test_backtest_by_cutoff(noise):
    df = noise(200, "x").select("id", "x", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (2 * F.col("x")).alias("y"))
    ols = {"Linear": LinearRegression(featuresCol="_features", labelCol="_label", solver="normal")}
    scores, agg = train.temporal_backtest(df, "y", "d", KEY, "2024-05-01", drop=["d"], estimators=ols, blend=False)
    assert {r["fold"] for r in scores.collect()} == {1}
    assert agg.where("metric = 'r2'").first()["mean"] == pytest.approx(1.0)


def test_reports_and_saved_run(spark, three, tmp_path):
    df = three.withColumns({"a2": F.col("a") * 2, "y": (F.col("y") == "top").cast("int")})
    out = report.train_report(df, "y", KEY, profile_first=True, estimators=tree(), blend=False)
    assert out["dropped"] == ["a"] and out["run"].features == ["b", "c", "a2"]
    codes = {r["code"] for r in out["findings"].collect()}
    assert {"few_models", "small_test", "low_importance"} <= codes
    assert out["artifacts"]["confusion_matrix"].count() == 4 and out["artifacts"]["roc_auc"].first()[0] > 0.9
    assert "b" in {r["feature"] for r in out["low_importance"].collect()}

    path = str(tmp_path / "run")
    save_run(spark, out["run"], path)
    again = load_run(spark, path)
    assert again.info() == out["run"].info()
    first = out["run"].score(df).orderBy("id").select("id", "prob_1", "y_predicted").collect()
    assert again.score(df).orderBy("id").select("id", "prob_1", "y_predicted").collect() == first

    tables = report.score_report(again, df, df, KEY, min_confidence=0.9)
    assert tables["summary"].first()["has_ground_truth"] and tables["drift"].where("status <> 'no_drift'").count() == 0
    assert sum(r["count"] for r in tables["distribution"].collect()) == 400
    assert "flagged_low_confidence" in tables["predictions"].columns

    source = str(tmp_path / "in")
    df.drop("y").write.parquet(source)
    stream = spark.readStream.schema(df.drop("y").schema).parquet(source)
    to = scratch_path(spark, "scored")
    query = again.score(stream).writeStream.option("checkpointLocation", scratch_path(spark, "s")).trigger(availableNow=True).start(to, format="parquet")
    query.awaitTermination()
    assert spark.read.parquet(to).orderBy("id").select("id", "prob_1", "y_predicted").collect() == first


def test_regression_reports(spark, noise):
    df = noise(150, "x").select("id", "x", (2 * F.col("x")).alias("y"))
    ols = {"Linear": LinearRegression(featuresCol="_features", labelCol="_label", solver="normal")}
    out = report.train_report(df, "y", KEY, estimators=ols, blend=False)
    assert out["artifacts"]["residual_stats"].first()["r2"] == pytest.approx(1.0)
    tables = report.score_report(out["run"], df)
    assert {"residual", "y_predicted"} <= set(tables["predictions"].columns)
    shap = explain.shapley_values(df, ["x"], KEY, out["run"].predict, background_rows=10, max_rows=20)
    meta = report.explanation_tables(shap, KEY, ["x"])["metadata"].first()
    assert meta["n_rows"] == 20 and meta["n_features"] == 1 and meta["top_features"] == ["x"]


def test_fit_takes_dates_booleans_and_text_labels(spark):
    import datetime as dt

    rows = [
        (i, f"kind{i % 25:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 25 * 10), i % 2 == 0, dt.datetime(2020, 1, 1, i % 24) if i % 5 else None, float("nan") if i % 7 == 0 else float(i % 25))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "id int, label string, day date, flag boolean, at timestamp, x double")
    from pyspark.ml.classification import RandomForestClassifier

    assert train.problem_type(df, "label") == "multiclass"
    est = {"Forest": RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=10, maxDepth=8, seed=1)}
    run, _ = train.fit(df, "label", ["id"], estimators=est, blend=False)
    assert run.kind == "multiclass" and len(run.classes) == 25 and set(run.features) == {"day", "flag", "at", "x"}
    assert run.evaluate(df)["accuracy"] > 0.8


def test_one_against_the_rest_gives_probabilities(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    df = spark.range(300).selectExpr("id", "cast(id % 3 as int) AS label", "cast(id % 3 as double) + (id % 10) / 8.0 AS x", "cast(id % 2 as double) AS noise")
    f = {"featuresCol": "_features", "labelCol": "_label"}
    est = {"Boost": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=2, seed=1, **f), **f)}
    run, _ = train.fit(df, "label", ["id"], estimators=est, blend=False)
    scored = run.score(df).collect()
    assert len({round(r.confidence, 6) for r in scored}) > 3 and all(r.confidence < 1 for r in scored)
    assert all(abs(r.prob_0 + r.prob_1 + r.prob_2 - 1) < 1e-9 for r in scored)
    assert run.evaluate(df)["log_loss"] < 1.1
    imp = {r.feature: r.importance for r in train.feature_importance(run, df, ["id"]).collect()}
    assert imp["x"] > 0.2 and abs(imp["noise"]) < 0.1
    assert "GradientBoosting" in train.candidates("multiclass")


def test_importance_by_the_metric_sees_every_class(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(600).selectExpr("id", "cast(id % 3 as int) AS label", "cast(id % 3 = 0 as double) AS zero", "cast(id % 3 = 2 as double) AS two")
    est = {"Linear": LogisticRegression(featuresCol="_features", labelCol="_label")}
    for metric in train.CLASS_METRICS:
        run, _ = train.fit(df, "label", ["id"], eval_metric=metric, estimators=est, blend=False)
        imp = {r.feature: r.importance for r in train.feature_importance(run, df, ["id"]).collect()}
        assert imp["zero"] > 0.05 and imp["two"] > 0.05, metric


def test_search_space_is_a_sample_of_the_grid():
    trials = train.search_space("GBM", "binary", 6)
    assert len({p["maxDepth"] for _, p in trials}) > 1 and len({p["maxIter"] for _, p in trials}) > 1
    assert len(train.search_space("RF", "binary", 20)) == 20


def test_registered_training_runs_the_defaults(monkeypatch):
    """The registered queries ask for no smaller search than the operators' own."""
    from workloads import models

    class Stop(Exception):
        pass

    def record(*args, **options):
        assert "quick" not in options and "n_trials" not in options
        raise Stop

    monkeypatch.setattr(models, "purchases", lambda *a: None)
    monkeypatch.setattr(models.splits, "train_test_split", lambda *a, **k: (None, None))
    for name, query in (("fit", "train_leaderboard"), ("tune_family", "tune_trials")):
        monkeypatch.setattr(models.train, name, record)
        with pytest.raises(Stop):
            models.R.queries[query](None, "")


def test_importance_by_auc(three):
    df = three.withColumn("y", (F.col("y") == "top").cast("int"))
    run, _ = train.fit(df, "y", KEY, estimators=tree(), blend=False, eval_metric="roc_auc")
    got = {r["feature"]: r["importance"] for r in train.feature_importance(run, df, KEY).collect()}
    assert set(got) == {"a", "b", "c"} and 0.2 < got["a"] < 0.7 and got["c"] == pytest.approx(0.0, abs=0.05)


def test_search_prepares_once(three, monkeypatch):
    made = []
    whole = train.preparation
    monkeypatch.setattr(train, "preparation", lambda *a: made.append(1) or whole(*a))
    run, table = train.tune_family(three, "y", KEY, "RF", n_trials=2)
    rows = table.collect()
    assert len(made) == 1 and [r["trial"] for r in rows][0] == run.best and set(run.models) == {run.best}
    assert {r["trial"] for r in rows} == {"RF_1", "RF_2"} and rows[0]["score_val"] >= rows[1]["score_val"]
    _, one = train.tune_family(three, "y", KEY, "RF", n_trials=2, time_limit=0.0)
    assert [r["trial"] for r in one.collect()] == ["RF_1"]


def test_fits_follow_the_rows_and_not_the_files(three, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from tablewright.plans import attach

    monkeypatch.setattr(attach, "ROWS_PER_PASS_TASK", 100)
    tasks = []

    class Forest(RandomForestClassifier):
        def _fit(self, rows):
            tasks.append(rows.rdd.getNumPartitions())
            return super()._fit(rows)

    df = three.localCheckpoint()
    trees = []
    for files in (1, 7):
        est = {"Forest": Forest(featuresCol="_features", labelCol="_label", numTrees=5, seed=1)}
        run, _ = train.fit(df.repartition(files), "y", KEY, estimators=est, blend=False)
        trees.append(run.models["Forest"].toDebugString.split("\n", 1)[1])
    assert tasks == [4, 4] and trees[0] == trees[1]


def test_trials_side_by_side_are_the_same(three):
    boards = []
    for many in (1, 3):
        run, table = train.tune_family(three, "y", KEY, "RF", n_trials=3, parallelism=many)
        boards.append(table.drop("fit_time").collect())
        assert list(run.models) == [run.best]
    assert boards[0] == boards[1] and len(boards[0]) == 3
