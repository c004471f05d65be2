"""Findings, pruning and run-comparison queries over leaderboards derived from lineitem.

Each supplier stands for a run and each line number for a model; scores are ratios of
integer sums, so both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import findings, report, runs, train
from tablewright.plans.lineage import scratch_path
from tablewright.sources import readers, writers
from workloads.common import Registry, rounded, table

R = Registry()

MODELS = ["LightGBM_BAG_L1", "CatBoost_BAG_L1", "RandomForestGini", "XGBoost", "KNeighborsDist", "NeuralNetTorch", "WeightedEnsemble_L2"]


def model_name(number):
    out = F.lit(MODELS[-1])
    for i, m in reversed(list(enumerate(MODELS[:-1], 1))):
        out = F.when(number == i, m).otherwise(out)
    return out


def model_sql(number):
    whens = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS[:-1], 1))
    return f"CASE {number} {whens} ELSE '{MODELS[-1]}' END"


def sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), "l_linenumber").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("t"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
    )


SUMS = """(SELECT l_suppkey AS run_id, l_linenumber, sum(round(l_discount * 100)::BIGINT)::BIGINT AS d,
  sum(round(l_tax * 100)::BIGINT)::BIGINT AS t, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2)"""
BOARD = f"""(SELECT run_id, {model_sql('l_linenumber')} AS model, 8.0::DOUBLE * d / (n * 100.0::DOUBLE) AS score_val,
  10.0::DOUBLE * t / (n * 100.0::DOUBLE) AS score_test, q::DOUBLE / n AS fit_time FROM {SUMS})"""
EDGES = f"""(SELECT run_id, {model_sql('l_linenumber')} AS parent, {model_sql('(l_linenumber % 7 + 1)')} AS child FROM {SUMS} WHERE t > 4 * n)"""
IMPORTANCE = f"(SELECT run_id, 'f' || l_linenumber AS feature, (t - 4 * n)::DOUBLE / (n * 100.0::DOUBLE) AS importance FROM {SUMS})"
BEST = f"(SELECT run_id, model AS best_model FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score_val DESC, model) AS k FROM {BOARD}) WHERE k = 1)"


def board(spark, sf_dir):
    scale = F.col("n") * 100.0
    return sums(spark, sf_dir).select(
        "run_id",
        model_name(F.col("l_linenumber")).alias("model"),
        (8.0 * F.col("d") / scale).alias("score_val"),
        (10.0 * F.col("t") / scale).alias("score_test"),
        (F.col("q").cast("double") / F.col("n")).alias("fit_time"),
    )


def edges(spark, sf_dir):
    return sums(spark, sf_dir).where("t > 4 * n").select(
        "run_id",
        model_name(F.col("l_linenumber")).alias("parent"),
        model_name(F.col("l_linenumber") % 7 + 1).alias("child"),
    )


def importance(spark, sf_dir):
    return sums(spark, sf_dir).select(
        "run_id",
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"),
        ((F.col("t") - 4 * F.col("n")).cast("double") / (F.col("n") * 100.0)).alias("importance"),
    )


def run_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("n_train"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_test"),
        F.count_distinct("l_quantity").alias("n_features"),
    )


SIZES = """(SELECT l_suppkey AS run_id, count(*) FILTER (l_returnflag <> 'R') AS n_train, count(*) FILTER (l_returnflag = 'R') AS n_test,
  count(DISTINCT l_quantity) AS n_features FROM lineitem GROUP BY 1)"""


def run_classes(spark, sf_dir):
    flag = F.when(F.col("l_quantity") > 47, "rare").otherwise("usual")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), flag.alias("class")).count()


CLASSES = """(SELECT l_suppkey AS run_id, CASE WHEN l_quantity > 47 THEN 'rare' ELSE 'usual' END AS class, count(*) AS count FROM lineitem GROUP BY 1, 2)"""

GAP = f"""(SELECT b.run_id, b.model, score_val, score_test, abs(score_val - score_test) AS gap,
  coalesce(abs(score_val - score_test) / nullif(abs(score_val), 0) * 100, 0) AS gap_pct FROM {BOARD} b JOIN {BEST} x ON x.run_id = b.run_id AND best_model = model)"""


@R.add(f"""SELECT run_id, model, round(score_val, 8) AS score_val, round(score_test, 8) AS score_test, round(gap, 8) AS gap, round(gap_pct, 6) AS gap_pct,
  CASE WHEN gap_pct > 10 THEN 'severe' WHEN gap_pct > 5 THEN 'moderate' ELSE 'none' END AS severity FROM {GAP}""")
def overfit_gap(spark, sf_dir):
    b = board(spark, sf_dir)
    out = findings.overfit_gap(b, b, findings.best_per_run(b))
    return rounded(rounded(out, 6, ["gap_pct"]), 8, ["score_val", "score_test", "gap"])


FAMILY = "CASE " + " ".join(
    f"WHEN lower(model) LIKE '%{f}%' THEN '{f}'"
    for f in ("weightedensemble", "catboost", "lightgbm", "xgboost", "randomforest", "extratrees", "knn", "neuralnet")
) + " ELSE model END"
DIVERSITY = f"""(WITH r AS (SELECT *, {FAMILY} AS family, row_number() OVER (PARTITION BY run_id ORDER BY score_test DESC, model) AS k,
  count(*) OVER (PARTITION BY run_id) AS n FROM {BOARD})
SELECT run_id, any_value(n)::BIGINT AS n_models, any_value(n) < 5 AS few_models, count(DISTINCT family)::BIGINT AS top_families,
  count(DISTINCT family) = 1 AND any_value(n) > 3 AS same_family FROM r WHERE k <= 3 GROUP BY 1)"""


@R.add(f"SELECT * FROM {DIVERSITY}")
def ensemble_diversity(spark, sf_dir):
    return findings.diversity(board(spark, sf_dir)).drop("family")


@R.add(f"""SELECT run_id, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (importance <= 0.001), '') AS low,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (importance < 0), '') AS harmful FROM {IMPORTANCE} GROUP BY 1""")
def importance_findings(spark, sf_dir):
    out = findings.importance_findings(importance(spark, sf_dir))
    return out.select("run_id", F.concat_ws(",", "low").alias("low"), F.concat_ws(",", "harmful").alias("harmful"))


@R.add(f"SELECT run_id, feature, importance < 0 AS negative FROM {IMPORTANCE} WHERE importance <= 0.001")
def low_importance(spark, sf_dir):
    table_ = importance(spark, sf_dir).select("run_id", F.struct("run_id", "feature").alias("feature"), "importance")
    low = train.low_importance(table_)
    return low.select("feature.run_id", "feature.feature", "negative")


@R.add(f"""SELECT run_id, n_train < n_features * 10 AS few_rows_per_feature, n_test < 100 AS small_test FROM {SIZES}""")
def size_findings(spark, sf_dir):
    return findings.size_findings(run_sizes(spark, sf_dir)).drop("rows_per_feature")


@R.add(f"""SELECT run_id, CASE WHEN max(count) / min(count) > 10 THEN 'severe' WHEN max(count) / min(count) > 3 THEN 'moderate' ELSE 'none' END AS severity
FROM {CLASSES} GROUP BY 1""")
def imbalance_findings(spark, sf_dir):
    return findings.imbalance_findings(run_classes(spark, sf_dir)).drop("ratio")


@R.add(f"""WITH codes AS (SELECT run_id, 'overfit_gap' AS code FROM {GAP} WHERE gap_pct > 5
UNION ALL SELECT run_id, 'few_models' FROM {DIVERSITY} WHERE few_models UNION ALL SELECT run_id, 'same_family' FROM {DIVERSITY} WHERE same_family
UNION ALL SELECT DISTINCT run_id, 'low_importance' FROM {IMPORTANCE} WHERE importance <= 0.001
UNION ALL SELECT DISTINCT run_id, 'harmful_features' FROM {IMPORTANCE} WHERE importance < 0
UNION ALL SELECT run_id, 'few_rows_per_feature' FROM {SIZES} WHERE n_train < n_features * 10
UNION ALL SELECT run_id, 'small_test' FROM {SIZES} WHERE n_test < 100
UNION ALL SELECT run_id, 'class_imbalance' FROM {CLASSES} GROUP BY 1 HAVING max(count) / min(count) > 3)
SELECT s.run_id, coalesce(string_agg(code, ',' ORDER BY code), 'clear') AS codes FROM {SIZES} s LEFT JOIN codes c ON c.run_id = s.run_id GROUP BY 1""")
def findings_table(spark, sf_dir):
    b, sizes = board(spark, sf_dir), run_sizes(spark, sf_dir)
    rows = findings.finding_rows(
        findings.overfit_gap(b, b, findings.best_per_run(b)),
        findings.diversity(b),
        findings.importance_findings(importance(spark, sf_dir)),
        findings.size_findings(sizes),
        findings.imbalance_findings(run_classes(spark, sf_dir)),
    )
    out = findings.findings_table(rows, sizes)
    return out.select("run_id", F.concat_ws(",", "findings.code").alias("codes"))


CLOSURE = f"""(WITH RECURSIVE e AS (SELECT * FROM {EDGES}), c AS (SELECT run_id, best_model AS model FROM {BEST}
  UNION SELECT c.run_id, child FROM c JOIN e ON e.run_id = c.run_id AND parent = model) SELECT * FROM c)"""


@R.add(f"SELECT * FROM {CLOSURE}")
def dependency_closure(spark, sf_dir):
    best = findings.best_per_run(board(spark, sf_dir))
    return findings.dependency_closure(edges(spark, sf_dir), best.select("run_id", F.col("best_model").alias("model")))


ENSEMBLE = f"""(SELECT b.*, model = best_model AS is_best, EXISTS (SELECT 1 FROM {CLOSURE} c WHERE c.run_id = b.run_id AND c.model = b.model) AS contributes_to_best,
  max(CASE WHEN model = best_model THEN score_val END) OVER (PARTITION BY b.run_id) AS best FROM {BOARD} b JOIN {BEST} x ON x.run_id = b.run_id)"""


@R.add(f"SELECT run_id, model, is_best, contributes_to_best FROM {ENSEMBLE}")
def ensemble_analysis(spark, sf_dir):
    out = findings.ensemble_analysis(board(spark, sf_dir), edges(spark, sf_dir))
    return out.select("run_id", "model", "is_best", "contributes_to_best")


ADVICE = f"""(SELECT run_id, model, abs(best - score_val) / abs(best) * 100 AS gap_pct FROM {ENSEMBLE}
WHERE NOT is_best AND NOT contributes_to_best AND best <> 0 AND abs(best - score_val) / abs(best) * 100 > 5)"""


@R.add(f"SELECT run_id, model, round(gap_pct, 6) AS gap_pct FROM {ADVICE}")
def prune_advice(spark, sf_dir):
    analysis = findings.ensemble_analysis(board(spark, sf_dir), edges(spark, sf_dir))
    return rounded(findings.prune_advice(analysis), 6)


@R.add(f"""SELECT b.run_id, count(*)::BIGINT AS total_models, count(a.model)::BIGINT AS pruned_count, (count(*) - count(a.model))::BIGINT AS remaining_count
FROM {BOARD} b LEFT JOIN {ADVICE} a ON a.run_id = b.run_id AND a.model = b.model GROUP BY 1""")
def pruning_report(spark, sf_dir):
    analysis = findings.ensemble_analysis(board(spark, sf_dir), edges(spark, sf_dir))
    return findings.pruning_report(analysis, findings.prune_advice(analysis))


@R.add(f"""WITH k AS (SELECT b.* FROM {BOARD} b ANTI JOIN {ADVICE} a ON a.run_id = b.run_id AND a.model = b.model)
SELECT run_id, model, round(fit_time / sum(fit_time) OVER (PARTITION BY run_id), 8) AS weight FROM k""")
def pruned_weights(spark, sf_dir):
    analysis = findings.ensemble_analysis(board(spark, sf_dir), edges(spark, sf_dir))
    kept = findings.apply_pruning(analysis, findings.prune_advice(analysis))
    weights = board(spark, sf_dir).select("run_id", "model", F.col("fit_time").alias("weight"))
    return rounded(findings.renormalised_weights(weights, kept), 8)


@R.add(f"SELECT run_id, feature, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS rank FROM {IMPORTANCE}) WHERE rank <= 5")
def top_features(spark, sf_dir):
    return runs.top_features(importance(spark, sf_dir)).select("run_id", "feature", "rank")


@R.add(f"""SELECT b.run_id, x.best_model, max(score_test) AS best_test_score, count(*)::BIGINT AS n_models, round(sum(fit_time), 2) AS total_fit_time,
  (SELECT string_agg(feature, ',' ORDER BY importance DESC, feature) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS k
    FROM {IMPORTANCE}) i WHERE k <= 5 AND i.run_id = b.run_id) AS top_5_features
FROM {BOARD} b JOIN {BEST} x ON x.run_id = b.run_id GROUP BY b.run_id, x.best_model""")
def run_compare(spark, sf_dir):
    b = board(spark, sf_dir)
    info = findings.best_per_run(b).select(
        "run_id", F.lit("regression").alias("problem_type"), F.lit("rmse").alias("eval_metric"), "best_model",
        F.array(F.lit("f1")).alias("features"),
    )
    out = runs.run_summary(info, None, b, b, importance(spark, sf_dir))
    return out.select(
        "run_id", "best_model", "best_test_score", "n_models", "total_fit_time",
        F.concat_ws(",", "top_5_features").alias("top_5_features"),
    )


@R.add(f"SELECT model, score_val, score_test FROM (SELECT DISTINCT ON (model) model, score_val, score_test FROM {BOARD} ORDER BY model, score_test DESC, run_id) ORDER BY score_test DESC, model LIMIT 10")
def leaderboard_top(spark, sf_dir):
    best = F.min(F.struct((-F.col("score_test")).alias("k"), "run_id", "score_val", "score_test"))
    per_model = board(spark, sf_dir).groupBy("model").agg(best.alias("b")).select("model", "b.score_val", "b.score_test")
    return runs.top_leaderboard(per_model)


def experiments(spark, sf_dir):
    """One log entry per customer with orders; every third carries an extra parameter."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("first")
    )
    more = F.when(F.col("o_custkey") % 3 == 0, F.map_from_arrays(F.array(F.lit("preset")), F.array(F.lit("best"))))
    base = F.map_from_arrays(F.array(F.lit("label")), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))
    return per.select(
        F.date_format(F.col("first").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("out/"), F.col("o_custkey").cast("string")).alias("output_dir"),
        F.map_concat(base, F.coalesce(more, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("params"),
        F.create_map(F.lit("orders"), F.col("n").cast("double"), F.lit("top"), F.col("top")).alias("metrics"),
        F.struct(F.lit("Linear").alias("best_model"), F.lit("regression").alias("problem_type")).alias("model_info"),
    )


EXPERIMENTS = """(SELECT strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS timestamp, 'out/' || o_custkey AS output_dir,
  'c' || o_custkey AS param_label, CASE WHEN o_custkey % 3 = 0 THEN 'best' END AS param_preset, count(*)::DOUBLE AS metric_orders,
  max(o_totalprice) AS metric_top, 'Linear' AS best_model, 'regression' AS problem_type FROM orders GROUP BY o_custkey)"""


@R.add(f"SELECT * FROM {EXPERIMENTS}")
def experiment_flatten(spark, sf_dir):
    return runs.compare_experiments(experiments(spark, sf_dir))


@R.add(f"SELECT * FROM {EXPERIMENTS} ORDER BY timestamp DESC, output_dir DESC LIMIT 25")
def experiment_last(spark, sf_dir):
    """Through the JSON-lines log: appended, read back, last 25 entries."""
    log = scratch_path(spark, "experiments")
    experiments(spark, sf_dir).write.mode("append").json(log)
    return runs.compare_experiments(readers.read_json_lines(spark, log), 25)


@R.add("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@R.add("""SELECT o_orderstatus AS run_id, count(*)::BIGINT AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def run_partitions(spark, sf_dir):
    """A shared table with one partition per run, read back with partition pruning."""
    path = scratch_path(spark, "runs")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("run_id"))
    df.write.partitionBy("run_id").parquet(path)
    return readers.read_parquet(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@R.add("""SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS c_name FROM orders UNION ALL SELECT NULL, NULL, c_name FROM customer""")
def ragged_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return readers.union_ragged([a, table(spark, sf_dir, "customer").select("c_name")])


def per_run(spark, sf_dir, of):
    """Leaderboard of every third supplier, one row per model."""
    third = board(spark, sf_dir).where(F.col("run_id") % 3 == of)
    return third.groupBy("model").agg(F.max("score_val").alias("score_val"), F.max("score_test").alias("score_test"), F.max("fit_time").alias("fit_time"))


@R.add(f"""SELECT 'run' || (run_id % 3) AS run_id, max(score_test) AS best_test_score, count(DISTINCT model)::BIGINT AS n_models FROM {BOARD} GROUP BY 1""")
def runs_from_csv(spark, sf_dir):
    """Three runs whose files name the same columns in other orders, one with a column more."""
    base = scratch_path(spark, "runs-csv")
    columns = [["model", "score_val", "score_test"], ["score_test", "model", "score_val", "fit_time"], ["model", "score_test", "score_val"]]
    for k, names in enumerate(columns):
        writers.write_csv(per_run(spark, sf_dir, k).select(*names), f"{base}/run{k}/leaderboard_test.csv")
    return runs.compare_runs(spark, base).select("run_id", "best_test_score", "n_models")


@R.add(f"""SELECT 'f' || l_linenumber AS feature, sum(t)::BIGINT AS importance FROM {SUMS} GROUP BY 1""")
def keyed_csv_importance(spark, sf_dir):
    """A CSV whose key column has no name."""
    path = scratch_path(spark, "importance-csv")
    rows = sums(spark, sf_dir).groupBy("l_linenumber").agg(F.sum("t").alias("t"))
    lines = rows.select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("t").cast("string")).alias("value"))
    # seven line numbers: one row holds the file
    whole = lines.agg(F.concat(F.lit(",importance\n"), F.array_join(F.sort_array(F.collect_list("value")), "\n")).alias("value"))
    whole.write.text(path)
    return readers.read_importance(spark, path).select("feature", F.col("importance").cast("bigint").alias("importance"))


@R.add("""SELECT o_orderstatus AS best_model, count(*)::BIGINT AS n_features FROM orders GROUP BY 1""")
def json_documents(spark, sf_dir):
    """One JSON document per file, read with its schema."""
    path = scratch_path(spark, "model-info")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("best_model")).agg(F.count(F.lit(1)).alias("n"))
    made = rows.select("best_model", F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x.cast("string")).alias("features"))
    made.repartition("best_model").write.option("maxRecordsPerFile", 1).json(path)
    read = readers.read_json_document(spark, path, readers.MODEL_INFO_SCHEMA)
    return read.select("best_model", F.size("features").cast("bigint").alias("n_features"))


@R.add("""SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1""")
def report_sink(spark, sf_dir):
    """Nested report rows written as JSON and read back."""
    path = scratch_path(spark, "report")
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).alias("facts")
    )
    writers.write_report(rows, path)
    back = spark.read.schema("segment string, facts struct<n:bigint,total:double>").json(path)
    return back.select("segment", "facts.n", "facts.total")


@R.add("""SELECT o_orderkey, ln(1 + o_totalprice) AS log_o_totalprice FROM orders""")
def engineer_and_save(spark, sf_dir):
    """Features and their spec saved together, the table read back."""
    path = scratch_path(spark, "features")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    report.engineer_and_save(df, {"log": ["o_totalprice"]}, path)
    return readers.read_parquet(spark, f"{path}/data").select("o_orderkey", "log_o_totalprice")
