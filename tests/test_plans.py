from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import splits
from tablewright.plans.attach import attach_group_stats
from tablewright.plans.cuts import hash_cuts
from tablewright.plans.selection import exact_quantiles, order_statistics
from tablewright.plans.totals import bucket_edges, running_totals

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = [(i, 5.0 if rng.random() < 0.4 else rng.gauss(0, 10), None if i % 3 else float(i)) for i in range(6000)]
    return spark.createDataFrame(rows, "id int, hot double, gaps double"), rows


@pytest.mark.parametrize("exact_rows", [20, 500, 100_000])
def test_quantiles_are_exact_on_every_path(values, exact_rows):
    df, rows = values
    got = exact_quantiles(df, ["hot", "gaps"], PROBS, builtin_rows=0, exact_rows=exact_rows)
    assert got["hot"] == pytest.approx(np.quantile([r[1] for r in rows], PROBS), abs=1e-12)
    assert got["gaps"] == pytest.approx(np.quantile([r[2] for r in rows if r[2] is not None], PROBS))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_order_statistics_report_rows_below(values):
    df, rows = values
    ordered = sorted(r[1] for r in rows)
    ranks = [0, 10, 3000, 5999]
    got = order_statistics(df.select("hot"), {"hot": ranks}, {"hot": 6000}, exact_rows=50)["hot"]
    for r in ranks:
        assert got[r] == (ordered[r], ordered.index(ordered[r]))
    with pytest.raises(ValueError, match="outside"):
        order_statistics(df.select("hot"), {"hot": [6000]}, {"hot": 6000})


@pytest.mark.parametrize("cell_rows", [1, 30, 10_000])
def test_hash_cuts_find_the_digest_at_a_rank(spark, cell_rows):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    ordered = {g: sorted(r["h"] for r in df.where(F.col("g") == g).collect()) for g in (0, 1)}
    got = hash_cuts(df, {0: [1, 500, 666], 1: [0, 17]}, 667, cell_rows)
    assert got[0] == [ordered[0][0], ordered[0][499], ordered[0][665]]
    assert got[1] == ["", ordered[1][16]]


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, buckets, descending):
    df = spark.range(300).select((F.col("id") * 1.5).alias("v"), (F.col("id") % 5).alias("n"))
    edges = [] if buckets == 1 else bucket_edges(df, "v")[::10]
    out = running_totals(df, "v", ["n"], edges, descending).orderBy("v" if not descending else F.desc("v")).collect()
    total = 0
    for i, r in enumerate(out):
        total += r["n"]
        assert r["cum_n"] == total
        assert r["next_n"] == (out[i + 1]["n"] if i + 1 < len(out) else None)


def test_attach_keeps_every_row_when_salted(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    out = attach_group_stats(df, stats, ["k"], "n", 2000, broadcast_groups=1, salts=4)
    assert out.count() == 2000 and out.where("n IS NULL").count() == 0
    assert out.where("k = 0").select("n").distinct().first()["n"] == 667


def test_no_plan_ranks_whole_rows(spark):
    """A split compares literals: neither a shuffle nor a sort of the table is left."""
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("y"), F.lit("wide").alias("payload"))
    plan = splits.assign_test(df, ["id"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
