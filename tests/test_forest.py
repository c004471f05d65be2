"""Forests of one search, grown together over counted cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tablewright.operators import evaluate, forest, train

KEY = ["id"]


def est(**params):
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", **{"seed": 5, **params})


@pytest.fixture(scope="module")
def mixed(noise):
    """Numbers, a text feature and a text label of three classes; every tenth label is another one."""
    side = F.when(F.col("a") + F.when(F.col("id") % 3 == 0, 0.7).otherwise(0.0) < -0.3, "low").when(F.col("b") < 0.4, "mid").otherwise("top")
    return noise(1_500, "a", "b").select(
        "id", F.round("a", 1).alias("a"), F.when(F.col("id") % 13 > 0, F.col("b")).alias("b"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"),
        F.when(F.col("id") % 10 == 0, F.lit("mid")).otherwise(side).alias("y"),
    ).localCheckpoint()


def prepared(df, label="y", features=("a", "b", "t")):
    from pyspark.ml import Pipeline

    classes = sorted(r[0] for r in df.select(label).distinct().collect())
    ready = Pipeline(stages=train.preparation(df, list(features))).fit(df).transform(train._with_label(df, label, classes))
    return ready.select("id", (F.col("id") % 4 == 0).alias("is_test"), "_label", "_features"), classes


def test_more_forests_take_no_more_jobs(spark, mixed):
    sc = spark.sparkContext
    jobs = {}
    for trials in (6, 18):
        sc.setJobGroup(f"search-{trials}", "")
        try:
            _, table = train.tune_family(mixed, "y", KEY, "RF", n_trials=trials)
        finally:
            sc._jsc.clearJobGroup()
        assert table.count() == trials
        jobs[trials] = len(sc.statusTracker().getJobIdsForGroup(f"search-{trials}"))
    assert jobs[18] <= jobs[6] + 8


def test_the_kept_model_scores_rows_as_the_cells_were_scored(mixed):
    ready, _ = prepared(mixed)
    search = forest.Search(ready, 3)
    trials = {"a": est(numTrees=7, maxDepth=4), "b": est(numTrees=4, maxDepth=6, featureSubsetStrategy="onethird", minInstancesPerNode=5)}
    search.grow(trials)
    slim = ready.where("is_test").select("_label", "_features").localCheckpoint()
    for name, e in trials.items():
        model = search.model(mixed.sparkSession, name, e)
        assert (model.getNumTrees, model.numFeatures, model.numClasses) == (e.getNumTrees(), search.slots, 3)
        assert max(t.depth for t in model.trees) <= e.getMaxDepth() and model.getOrDefault("maxDepth") == e.getMaxDepth()
        want: dict = {}
        for r in model.transform(slim).select("_label", "probability").collect():
            at = (int(r["_label"]), tuple(np.round(r["probability"].toArray(), 12)))
            want[at] = want.get(at, 0) + 1
        got: dict = {}
        for r in search.scored().where(F.col("model") == name).collect():
            at = (r["y"], tuple(np.round(r["value"], 12)))
            got[at] = got.get(at, 0) + r["n"]
        assert got == want and len(got) > 10


def test_board_is_what_the_model_scores_on_the_held_out_rows(mixed):
    run, table = train.tune_family(mixed, "y", KEY, "RF", n_trials=3, eval_metric="log_loss")
    held = train.assign_test(mixed, KEY, "y", train.VALIDATION_FRACTION, train.K.SEED).where("is_test").drop("is_test")
    assert -run.evaluate(held)["log_loss"] == pytest.approx(table.first()["score_val"], abs=1e-12)
    assert run.evaluate(held)["accuracy"] > 0.85
    two = mixed.withColumn("y", F.col("y") == "top")
    run, table = train.tune_family(two, "y", KEY, "RF", n_trials=2, eval_metric="roc_auc")
    held = train.assign_test(two, KEY, "y", train.VALIDATION_FRACTION, train.K.SEED).where("is_test").drop("is_test")
    assert run.evaluate(held)["roc_auc"] == pytest.approx(table.first()["score_val"], abs=1e-12)


def test_a_forest_grown_alone_is_the_same(mixed):
    # the median of an Imputer is a sketch that depends on files
    mixed = mixed.fillna(0.0, ["b"])
    whole, all_rows = train.tune_family(mixed.repartition(1), "y", KEY, "RF", n_trials=4)
    one, by_one = train.tune_family(mixed.repartition(7), "y", KEY, "RF", n_trials=4, time_limit=3_600.0)
    assert all_rows.drop("fit_time").collect() == by_one.drop("fit_time").collect()
    trees = [r.models[r.best].toDebugString.split("\n", 1)[1] for r in (whole, one)]
    assert whole.best == one.best and trees[0] == trees[1]


def test_every_node_has_its_rows_and_its_best_split(mixed, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_PER_PASS_TASK", 150)
    monkeypatch.setattr(forest, "LEVEL_BYTES", 40_000)
    ready, _ = prepared(mixed)
    search = forest.Search(ready, 3)
    assert search.cells.rdd.getNumPartitions() > 3
    total = search.cells.agg(F.sum("n"), F.count("n")).first()
    assert total[0] == 1_500 and total[1] < 1_500
    grown = forest.grow(search.cells, search.slots, search.n_bins, 3, 2, [1, 6], 3, 5, 5)
    parts: dict = {}
    for r in search.cells.where("NOT is_test").collect():
        parts.setdefault(r["part"], []).append(r)
    bins = np.array([list(r["key"]) for p in parts.values() for r in p])
    y = np.array([r["y"] for p in parts.values() for r in p])
    splits = 0
    for tree in range(3):
        weight = np.concatenate([forest.draw_bag(5, tree, part, np.array([r["n"] for r in p])) for part, p in parts.items()])
        for at_set, least in enumerate(grown.leasts):
            todo = [(int(grown.roots[tree, at_set]), np.ones(len(y), bool))]
            while todo:
                node, here = todo.pop()
                counts = np.bincount(y[here], weight[here], 3)
                assert grown.counts[node].tolist() == counts.tolist()
                drawn = forest._drawn_features(5, np.array([tree]), grown.place[node : node + 1], search.slots, 2)[0]
                gains = {}
                for f in drawn:
                    for b in range(search.n_bins - 1):
                        right = here & (bins[:, f] > b)
                        c = np.bincount(y[right], weight[right], 3)
                        low, n = counts - c, counts.sum()
                        if min(c.sum(), low.sum()) >= least:
                            sq = [(x**2).sum() / x.sum() for x in (low, c, counts)]
                            gains[int(f), b] = (sq[0] + sq[1] - sq[2]) / n
                if grown.left[node] == node:
                    assert grown.level[node] == 5 or counts.max() == counts.sum() or max(gains.values(), default=0) < 1e-9
                    continue
                splits += 1
                f, b = int(grown.feature[node]), int(grown.cut[node])
                assert gains[f, b] == pytest.approx(max(gains.values()), abs=1e-9)
                right = here & (bins[:, f] > b)
                todo += [(int(grown.left[node]), here & ~right), (int(grown.left[node]) + 1, right)]
    assert splits > 40


def test_bags_are_poisson_in_the_rows_of_a_cell():
    n = np.repeat([1, 7, 400], 20_000)
    drawn = forest.draw_bag(1, 3, 0, n)
    for k in (1, 7, 400):
        x = drawn[n == k]
        assert x.mean() == pytest.approx(k, rel=0.03) and x.var() == pytest.approx(k, rel=0.05)
    assert (forest.draw_bag(1, 3, 0, n) == drawn).all() and (forest.draw_bag(1, 4, 0, n) != drawn).any()


def test_trees_are_alike_mllibs(mixed):
    """Mean size of the trees and accuracy of the forests over seeds."""
    ready, _ = prepared(mixed)
    ready = ready.localCheckpoint()
    fitting, held = ready.where("NOT is_test"), ready.where("is_test")
    search = forest.Search(ready, 3)
    sizes: dict = {"mllib": [], "shared": []}
    right: dict = {"mllib": [], "shared": []}
    for seed in (1, 2):
        e = est(numTrees=40, maxDepth=6, seed=seed)
        search.grow({"x": e})
        for name, model in (("mllib", e.fit(fitting)), ("shared", search.model(mixed.sparkSession, "x", e))):
            sizes[name] += [t.numNodes for t in model.trees]
            right[name].append(model.transform(held).where("prediction = _label").count() / held.count())
    a, b = (np.array(sizes[k], float) for k in ("mllib", "shared"))
    assert abs(a.mean() - b.mean()) < 4 * np.sqrt(a.var() / len(a) + b.var() / len(b))
    assert np.mean(right["shared"]) == pytest.approx(np.mean(right["mllib"]), abs=0.04)


def test_edges_of_few_and_of_many_values(spark):
    df = spark.range(5_000).selectExpr("id", "cast(id % 3 as double) AS few", "cast(id as double) AS many", "7.0D AS one", "IF(id % 2 = 0, double('NaN'), 1.0D) AS gap")
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["few", "many", "one", "gap"], outputCol="_features", handleInvalid="keep").transform(df)
    few, many, one, gap = forest.bin_edges(rows, 4, 32)
    assert few.tolist() == [0.5, 1.5] and one.tolist() == gap.tolist() == []
    assert len(many) == 31 and np.abs(many - np.arange(1, 32) * 5_000 / 32).max() < 5


def test_rows_without_a_twin_are_cells_of_their_own(spark, noise, monkeypatch):
    monkeypatch.setattr(forest, "BIN_BYTES_PER_TASK", 4_000)
    names = [f"v{i}" for i in range(20)]
    df = noise(600, *names).localCheckpoint().withColumn("y", (F.col("v0") + F.col("v1") > 0).cast("int"))
    ready, _ = prepared(df, features=names)
    search = forest.Search(ready, 2)
    assert search.cells.count() == 600 and search.cells.rdd.getNumPartitions() >= 3
    search.grow({"x": est(numTrees=15, maxDepth=4)})
    value = search.scored().select("y", F.get("value", F.lit(1)).alias("p"))
    assert value.where("(p > 0.5) = (y = 1)").count() > 0.75 * value.count()


def test_other_forests_are_left_to_mllib(mixed):
    assert forest.can_share({"a": est(), "b": est(maxDepth=3, minInstancesPerNode=2)}, 3)
    for other in (est(impurity="entropy"), est(seed=6), est(maxDepth=0), est(featureSubsetStrategy="3"), est(subsamplingRate=0.5)):
        assert not forest.can_share({"a": est(), "b": other}, 3)
    assert not forest.can_share({"a": est()}, 0)


def test_nodes_with_large_counts_leave_the_search_to_mllib(mixed, monkeypatch):
    monkeypatch.setattr(forest, "NODE_BYTES", 1)
    monkeypatch.setattr(forest, "count_cells", None)
    run, table = train.tune_family(mixed, "y", KEY, "RF", n_trials=2)
    assert table.count() == 2 and list(run.models) == [run.best] and table.first()["trial"] == run.best


def test_counted_rows_score_as_single_rows(spark):
    rows = [("m", i % 3, (i * 7) % 3, (i % 9 + 1) / 10, i % 4 + 1) for i in range(40)]
    counted = spark.createDataFrame(rows, "model string, actual int, predicted int, q double, n bigint").localCheckpoint()
    single = counted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("_", "n")
    a = evaluate.classification_scores(counted, prob_of_actual=F.col("q"), positive="1", by=["model"], rows=F.col("n")).first()
    b = evaluate.classification_scores(single, prob_of_actual=F.col("q"), positive="1", by=["model"]).first()
    assert all(a[c] == pytest.approx(b[c], abs=1e-12) for c in a.asDict() if c != "model")
    t = evaluate.threshold_table(counted, "actual", "q", 1, rows=F.col("n")).collect()
    assert sorted(t) == sorted(evaluate.threshold_table(single, "actual", "q", 1).collect())
