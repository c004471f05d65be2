from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(503).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual").alias("y"), F.col("id").cast("double").alias("x"))


def test_stratified_split_is_complete_and_proportional(rows):
    train, test = splits.train_test_split(rows, "y", ["id"], drop=["x", "absent"])
    assert test.count() == 101 and train.count() == 402
    assert train.join(test, "id").count() == 0 and "x" not in train.columns
    assert test.where("y = 'rare'").count() == 10


def test_split_does_not_depend_on_partitioning(rows, spark):
    a = {r["id"] for r in splits.assign_test(rows, ["id"], "y").where("is_test").collect()}
    b = {r["id"] for r in splits.assign_test(rows.repartition(7), ["id"], "y", cell_rows=5).where("is_test").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    c = {r["id"] for r in splits.assign_test(rows, ["id"], "y").where("is_test").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b == c
    other = {r["id"] for r in splits.assign_test(rows, ["id"], "y", seed=1).where("is_test").collect()}
    assert other != a


def test_split_errors(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, y string")
    with pytest.raises(ValueError, match="only one row"):
        splits.assign_test(one, ["id"], "y")
    gap = spark.createDataFrame([(1, "a"), (2, None)], "id int, y string")
    with pytest.raises(ValueError, match="NULL"):
        splits.assign_test(gap, ["id"], "y")


def test_folds_are_balanced_overall_and_per_class(rows):
    out = splits.assign_folds(rows, ["id"], 4, "y")
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sorted(sizes) == [125, 126, 126, 126]
    rare = [r["count"] for r in out.where("y = 'rare'").groupBy("fold").count().collect()]
    assert max(rare) - min(rare) <= 1 and sum(rare) == 51
    assert splits.fold_plan([3, 4], 3) == [[1, 1, 1], [2, 1, 1]]
    with pytest.raises(ValueError, match="fewer"):
        splits.assign_folds(rows.limit(2), ["id"], 4)


def test_robust_scale_uses_train_only(spark):
    train = spark.createDataFrame([(float(i), 7.0) for i in range(1, 6)], "x double, c double")
    test = spark.createDataFrame([(100.0, 8.0), (None, 7.0)], "x double, c double")
    a, b = splits.robust_scale(train, [test])
    assert [r["x"] for r in a.orderBy("x").collect()] == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert [r["x"] for r in b.collect()] == [48.5, None]
    assert [r["c"] for r in b.collect()] == [1.0, 0.0]  # zero IQR divides by one


@pytest.fixture(scope="module")
def dated(spark):
    """A third of all rows share one date."""
    day = F.when(F.col("id") < 100, F.lit(50)).otherwise(F.col("id") % 100)
    return spark.range(301).select("id", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("d"))


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_walk_forward_cuts_inside_a_heavy_date(dated, cell_rows):
    out = splits.walk_forward(dated, "d", ["id"], 3, cell_rows=cell_rows)
    n = {(r["fold"], r["role"]): r["count"] for r in out.groupBy("fold", "role").count().collect()}
    assert n == {(1, "train"): 75, (1, "test"): 75, (2, "train"): 150, (2, "test"): 75, (3, "train"): 225, (3, "test"): 76}
    for f in (1, 2, 3):
        ends = {r["role"]: r for r in splits.fold_ranges(out, "d").where(F.col("fold") == f).collect()}
        assert ends["train"]["last_date"] <= ends["test"]["first_date"]
        both = out.where(F.col("fold") == f)
        assert both.where("role = 'train'").join(both.where("role = 'test'"), "id").count() == 0
    with pytest.raises(ValueError, match="2 dated rows cannot make 4 chunks"):
        splits.walk_forward(dated.limit(2), "d", ["id"], 3)


def test_cutoff(dated):
    train, test = splits.cutoff_split(dated, "d", "2024-02-01")
    assert train.count() + test.count() == 301
    with pytest.raises(ValueError, match="nothing on one side of 2020-01-01.*2024-01-01"):
        splits.cutoff_split(dated, "d", "2020-01-01")


def test_global_row_number_with_a_hot_value(dated):
    out = splits.global_row_number(dated, "d", ["id"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == list(range(1, 302))
    assert all(a["d"] <= b["d"] for a, b in zip(out, out[1:], strict=False))


def test_score_aggregates(spark):
    df = spark.createDataFrame([(1, {"f1": 0.7, "rmse": 0.5}), (2, {"f1": 0.9, "rmse": 0.3}), (3, {"rmse": 0.4})], "fold int, scores map<string,double>")
    got = {r["metric"]: (r["mean"], r["std"]) for r in splits.aggregate_score_maps(df).collect()}
    assert got["f1"] == (0.8, 0.1) and got["rmse"][0] == 0.4


@pytest.fixture(scope="module")
def many(spark):
    """Classes of 2 to 8 rows, and one that holds a third of all rows."""
    small = spark.range(400).select(F.explode(F.sequence(F.lit(0), 1 + F.col("id") % 7)).alias("k"), F.format_string("c%03d", "id").alias("y"))
    hot = spark.range(900).select(F.col("id").alias("k"), F.lit("hot").alias("y"))
    return small.unionByName(hot).withColumns({"is_test": F.lit("mine"), "edges": F.lit(1)}).persist()


@pytest.mark.parametrize("cell_rows", [7, 50_000])
def test_strata_as_a_table_equal_literals(many, monkeypatch, cell_rows):
    rows, key = many.drop("is_test"), ["k", "y"]
    literal = splits.assign_test(rows, key, "y", test_size=0.3), splits.assign_folds(rows, key, 3, "y")
    want = [{tuple(r) for r in df.collect()} for df in literal]
    monkeypatch.setattr(splits, "MAX_STRATA", 10)
    tables = splits.assign_test(rows, key, "y", test_size=0.3, cell_rows=cell_rows), splits.assign_folds(rows, key, 3, "y", cell_rows=cell_rows)
    for df, expected in zip(tables, want, strict=True):
        assert {tuple(r) for r in df.collect()} == expected and len(expected) == rows.count()
    assert splits.assign_test(many, key, "y", test_size=0.3).schema["is_test"].dataType.simpleString() == "boolean"


def test_fifty_thousand_strata(spark):
    small = spark.range(100_000).select("id", F.format_string("c%d", F.col("id") % 50_000).alias("y"))
    df = small.unionByName(spark.range(100_000, 150_000).select("id", F.lit("hot").alias("y")))
    out = splits.assign_test(df, ["id"], "y", test_size=0.5)
    sizes = out.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n"))
    assert sizes.where("t * 2 <> n").count() == 0 and sizes.count() == 50_001
