from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import findings, runs
from tablewright.sources import readers, writers

BOARD = [("WeightedEnsemble_L2", 0.95), ("LightGBM", 0.93), ("CatBoost", 0.90), ("RandomForest", 0.80), ("KNN", 0.60)]


@pytest.fixture(scope="module")
def board(spark):
    return spark.createDataFrame([("r", m, s, s - 0.02, 1.0) for m, s in BOARD], "run_id string, model string, score_val double, score_test double, fit_time double")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("r", "WeightedEnsemble_L2", "LightGBM"), ("r", "WeightedEnsemble_L2", "CatBoost"), ("r", "CatBoost", "WeightedEnsemble_L2"), ("q", "LightGBM", "KNN")]
    return spark.createDataFrame(rows, "run_id string, parent string, child string")


def test_pruning(board, edges):
    analysis = findings.ensemble_analysis(board, edges)
    advice = findings.prune_advice(analysis)
    assert sorted(r["model"] for r in advice.collect()) == ["KNN", "RandomForest"]
    assert findings.apply_pruning(analysis, advice).count() == 3 and findings.apply_pruning(analysis, advice, dry_run=True).count() == 5
    report = findings.pruning_report(analysis, advice).first()
    assert (report["total_models"], report["pruned_count"], report["remaining_count"]) == (5, 2, 3)
    weights = board.select("run_id", "model", F.lit(0.2).alias("weight"))
    new = findings.renormalised_weights(weights, findings.apply_pruning(analysis, advice)).collect()
    assert sum(r["weight"] for r in new) == pytest.approx(1.0) and len(new) == 3


def test_closure_of_a_cycle_ends_and_depth_is_checked(spark):
    chain = spark.createDataFrame([("r", str(i), str(i + 1)) for i in range(5)] + [("r", "5", "0")], "run_id string, parent string, child string")
    start = spark.createDataFrame([("r", "3")], "run_id string, model string")
    assert findings.dependency_closure(chain, start).count() == 6
    with pytest.raises(ValueError, match="deeper"):
        findings.dependency_closure(chain, start, max_depth=2)


def test_rules(spark, board):
    best = findings.best_per_run(board)
    gap = findings.overfit_gap(board, board, best).first()
    assert gap["severity"] == "none" and gap["model"] == "WeightedEnsemble_L2"
    zero = spark.createDataFrame([("z", "m", 0.0, 0.5)], "run_id string, model string, score_val double, score_test double")
    assert findings.overfit_gap(zero, zero, findings.best_per_run(zero)).first()["gap_pct"] == 0.0
    same = spark.createDataFrame([("s", f"LightGBM_{i}", 0.9, 0.9 - i / 100) for i in range(4)], "run_id string, model string, score_val double, score_test double")
    row = findings.diversity(same).first()
    assert row["same_family"] and row["family"] == "lightgbm" and row["few_models"]
    assert not findings.diversity(board).first()["same_family"]
    imp = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.0001), ("r", "c", -0.1)], "run_id string, feature string, importance double")
    row = findings.importance_findings(imp).first()
    assert row["low"] == ["b", "c"] and row["harmful"] == ["c"]
    sizes = findings.size_findings(spark.createDataFrame([("r", 50, 20, 10)], "run_id string, n_train int, n_test int, n_features int")).first()
    assert sizes["few_rows_per_feature"] and sizes["small_test"] and sizes["rows_per_feature"] == 5.0
    classes = spark.createDataFrame([("r", "a", 50), ("r", "b", 10), ("q", "a", 110), ("q", "b", 10)], "run_id string, class string, count bigint")
    assert {r["run_id"]: r["severity"] for r in findings.imbalance_findings(classes).collect()} == {"r": "moderate", "q": "severe"}


def test_findings_table_has_an_all_clear(spark, board):
    few = board.limit(2).withColumn("run_id", F.lit("few"))
    both = board.unionByName(few)
    sizes = spark.createDataFrame([("r", 5000, 500, 10), ("few", 5000, 500, 10)], "run_id string, n_train int, n_test int, n_features int")
    imp = spark.createDataFrame([("r", "a", 0.5), ("few", "a", 0.5)], "run_id string, feature string, importance double")
    rows = findings.finding_rows(
        findings.overfit_gap(both, both, findings.best_per_run(both)), findings.diversity(both),
        findings.importance_findings(imp), findings.size_findings(sizes),
    )
    got = {r["run_id"]: [f["code"] for f in r["findings"]] for r in findings.findings_table(rows, sizes).collect()}
    assert got == {"r": ["clear"], "few": ["few_models"]}


def make_run(path, name, score, with_cv=False):
    d = path / name
    d.mkdir(parents=True)
    (d / "model_info.json").write_text(json.dumps({"problem_type": "binary", "eval_metric": "f1", "best_model": "GBM", "features": ["a", "b"]}, indent=2))
    (d / "analysis.json").write_text(json.dumps({"findings": ["x", "y"], "recommendations": ["z"]}))
    (d / "leaderboard_test.csv").write_text(f"model,score_test\nGBM,{score}\nRF,0.5\n")
    (d / "leaderboard.csv").write_text("model,score_val,fit_time\nGBM,0.9,1.5\nRF,0.8,2.25\n")
    (d / "feature_importance.csv").write_text(",importance,stddev\n" + "".join(f"f{i},{i / 10},0\n" for i in range(7)))
    if with_cv:
        (d / "cv_summary.json").write_text(json.dumps({"n_folds": 3, "aggregate_scores": {"f1": {"mean": 0.85, "std": 0.05}}}))


def test_run_directories(spark, tmp_path):
    make_run(tmp_path, "run_1", 0.9, with_cv=True)
    make_run(tmp_path, "run_2", 0.7)
    (tmp_path / "run_2" / "analysis.json").unlink()
    got = {r["run_id"]: r for r in runs.compare_runs(spark, str(tmp_path)).collect()}
    a, b = got["run_1"], got["run_2"]
    assert a["best_test_score"] == 0.9 and a["n_models"] == 2 and a["total_fit_time"] == 3.75 and a["n_features"] == 2
    assert a["top_5_features"] == ["f6", "f5", "f4", "f3", "f2"] and a["n_findings"] == 2
    assert (a["cv_folds"], a["cv_f1_mean"], b["cv_f1_mean"], b["n_findings"]) == (3, 0.85, None, None)
    assert runs.compare_runs(spark, str(tmp_path)).columns[:4] == ["run_id", "problem_type", "eval_metric", "best_model"]


def test_artifacts_written_by_spark_keep_their_run(spark, tmp_path):
    df = spark.createDataFrame([("GBM", 0.5)], "model string, score_test double")
    for r in ("x", "y"):
        writers.write_csv(df, str(tmp_path / r / "leaderboard_test.csv"))
    got = readers.read_run_artifact(spark, str(tmp_path), "leaderboard_test.csv")
    assert sorted(r["run_id"] for r in got.collect()) == ["x", "y"]
    assert readers.read_run_artifact(spark, str(tmp_path), "absent.csv") is None


def test_experiment_log(spark, tmp_path):
    log = str(tmp_path / "log")
    assert readers.read_json_lines(spark, log).count() == 0
    writers.record_experiment(spark, log, "out/1", {"label": "y", "preset": None}, {"f1": 0.8})
    writers.record_experiment(spark, log, "out/2", {"label": "y", "seed": 7}, {"f1": 0.9, "auc": 1}, {"best_model": "GBM", "problem_type": "binary"})
    rows = runs.compare_experiments(readers.read_json_lines(spark, log)).orderBy("timestamp").collect()
    assert [r["output_dir"] for r in rows] == ["out/1", "out/2"]
    assert rows[0]["param_seed"] is None and rows[1]["param_seed"] == "7" and rows[1]["metric_auc"] == 1.0 and rows[1]["best_model"] == "GBM"
    assert [r["output_dir"] for r in runs.compare_experiments(readers.read_json_lines(spark, log), 1).collect()] == ["out/2"]
    (tmp_path / "old.jsonl").write_text('{"timestamp":"t","output_dir":"o","params":{"a":"1"},"metrics":{}}\n\n')
    assert readers.read_json_lines(spark, str(tmp_path / "old.jsonl")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    writers.write_table(df, str(tmp_path / "t"), run_id=writers.new_run_id("fit"))
    writers.write_table(df, str(tmp_path / "t"), run_id=writers.new_run_id("fit"))
    assert spark.read.parquet(str(tmp_path / "t")).select("run_id").distinct().count() == 2
    writers.write_report(df.select(F.struct("a", "b").alias("s")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["s"]["b"] == 2.5
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_csv(df, str(tmp_path / "r"))
    doc = readers.read_json_document(spark, str(tmp_path / "none.json"), "a int")
    assert doc.count() == 0 and doc.columns == ["a", "_file"]
    assert readers.union_ragged([df, df.select("a").withColumn("c", F.lit("x"))]).columns == ["a", "b", "c"]


def test_run_files_are_matched_by_name(spark, tmp_path):
    texts = {"a": "model,score_test,score_val\nm,0.5,1\n", "b": "model,score_val,score_test\nm,2,0.7\n", "c": "score_test,model,fit_time\n1,n,3.5\n"}
    for run, text in texts.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "leaderboard_test.csv").write_text(text)
    board = readers.read_run_artifact(spark, str(tmp_path), "leaderboard_test.csv")
    got = {r.run_id: (r.model, float(r.score_test), r.score_val, r.fit_time) for r in board.collect()}
    assert got == {"a": ("m", 0.5, 1, None), "b": ("m", 0.7, 2, None), "c": ("n", 1.0, None, 3.5)}
    typed = readers.read_run_artifact(spark, str(tmp_path), "leaderboard_test.csv", "model string, score_test double")
    assert dict(typed.dtypes)["score_test"] == "double" and typed.agg({"score_test": "sum"}).first()[0] == pytest.approx(2.2)
    best = {r.run_id: r.best_test_score for r in runs.compare_runs(spark, str(tmp_path)).collect()}
    assert best == {"a": 0.5, "b": 0.7, "c": 1.0}


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    whole = findings.cut
    monkeypatch.setattr(findings, "cut", lambda df: calls.append(1) or whole(df))
    chain = spark.range(3000).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    start = spark.createDataFrame([("r", "0"), ("other", "0")], "run_id string, model string")
    got = findings.dependency_closure(chain, start)
    assert got.where("run_id = 'r'").count() == 3001 and got.where("run_id = 'other'").count() == 1
    assert len(calls) <= 2 + 2 * 12
    assert findings.dependency_closure(chain.limit(0), start).count() == 2


def test_closure_of_branches_against_a_walk(spark):
    links = [(run, i, j) for run in "ab" for i in range(40) for j in range(40) if (i * 7 + j * 11 + ord(run)) % 37 == 0]
    edges = spark.createDataFrame([(r, str(i), str(j)) for r, i, j in links], "run_id string, parent string, child string")
    want, todo = set(), [("a", 1), ("b", 2), ("b", 5)]
    start = spark.createDataFrame([(r, str(i)) for r, i in todo], "run_id string, model string")
    while todo:
        at = todo.pop()
        if at not in want:
            want.add(at)
            todo += [(r, j) for r, i, j in links if (r, i) == at]
    assert {(r["run_id"], int(r["model"])) for r in findings.dependency_closure(edges, start).collect()} == want
