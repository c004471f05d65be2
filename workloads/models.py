"""Training, scoring and streaming queries.

Tree ensembles and iterative fits have no SQL twin and are checked by rows only; ordinary
least squares does, so fitting, cross-validation and back-testing are also run with it.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators import drift, explain, quantile, report, shapley, splits, train
from tablewright.plans.lineage import scratch_path
from tablewright.streaming import monitor
from workloads.common import REGRESSION_SQL, Registry, rounded, scored_regression, table

R = Registry()

H = "md5(concat_ws('|', o_orderkey, '42'))"


def priced(spark, sf_dir):
    """Orders with one feature and a target that depends on it."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.month("o_orderdate").cast("double").alias("month"),
        (F.col("o_totalprice") / 100000 + 0.3 * F.month("o_orderdate")).alias("y"),
    )


PRICED = """(SELECT o_orderkey, o_orderdate, month(o_orderdate)::DOUBLE AS month, o_totalprice / 100000 + 0.3 * month(o_orderdate) AS y FROM orders)"""


def ols():
    return {"Linear": LinearRegression(featuresCol="_features", labelCol="_label", solver="normal")}


ERRORS = """sqrt(avg((y - b - a * month) * (y - b - a * month))) AS rmse, avg(abs(y - b - a * month)) AS mae,
  1 - sum((y - b - a * month) * (y - b - a * month)) / (var_pop(y) * count(*)) AS r2"""


FIT_SCORES = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {H}) AS i, ceil(0.2 * count(*) OVER ()) AS nt FROM {PRICED}),
tr AS (SELECT *, row_number() OVER (ORDER BY {H}) AS j, ceil(0.2 * count(*) OVER ()) AS nv FROM o WHERE i > nt),
m AS (SELECT regr_slope(y, month) AS a, regr_intercept(y, month) AS b FROM tr WHERE j > nv)
SELECT round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(r2, 5) AS r2 FROM (SELECT {ERRORS} FROM o, m WHERE i <= nt)"""


@R.add(FIT_SCORES)
def linear_fit_scores(spark, sf_dir):
    """Split, hold out a validation slice, fit, score the test rows."""
    fit_on, test = splits.train_test_split(priced(spark, sf_dir), "y", ["o_orderkey"], stratify=False)
    run, _ = train.fit(fit_on, "y", ["o_orderkey"], estimators=ols(), blend=False)
    s = run.evaluate(test)
    row = (s["root_mean_squared_error"], s["mean_absolute_error"], s["r2"])
    return rounded(spark.createDataFrame([row], "rmse double, mae double, r2 double"), 5)


@R.add(f"""WITH o AS (SELECT *, ntile(3) OVER (ORDER BY {H}) AS fold FROM {PRICED}),
p AS (SELECT k.f, o.*, row_number() OVER (PARTITION BY k.f ORDER BY {H}) AS j, ceil(0.2 * count(*) OVER (PARTITION BY k.f)) AS nv
  FROM o JOIN range(1, 4) k(f) ON fold <> k.f),
m AS (SELECT f, regr_slope(y, month) AS a, regr_intercept(y, month) AS b FROM p WHERE j > nv GROUP BY 1),
s AS (SELECT f, {ERRORS} FROM o JOIN m ON fold = f GROUP BY f)
SELECT 'root_mean_squared_error' AS metric, round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS std, 3::BIGINT AS folds FROM s
UNION ALL SELECT 'mean_absolute_error', round(avg(mae), 4), round(stddev_pop(mae), 4), 3 FROM s
UNION ALL SELECT 'r2', round(avg(r2), 4), round(stddev_pop(r2), 4), 3 FROM s""")
def cv_scores(spark, sf_dir):
    _, agg = train.cross_validate(priced(spark, sf_dir), "y", ["o_orderkey"], 3, estimators=ols(), blend=False)
    return rounded(agg, 4)


@R.add(f"""WITH o AS (SELECT *, least((row_number() OVER (ORDER BY o_orderdate, {H}) - 1) // (count(*) OVER () // 3), 2) AS c FROM {PRICED}),
p AS (SELECT k.f, o.*, row_number() OVER (PARTITION BY k.f ORDER BY {H}) AS j, ceil(0.2 * count(*) OVER (PARTITION BY k.f)) AS nv
  FROM o JOIN range(1, 3) k(f) ON c < k.f),
m AS (SELECT f, regr_slope(y, month) AS a, regr_intercept(y, month) AS b FROM p WHERE j > nv GROUP BY 1),
s AS (SELECT f, {ERRORS} FROM o JOIN m ON c = f GROUP BY f)
SELECT f::INT AS fold, round(rmse, 5) AS rmse, round(mae, 5) AS mae FROM s""")
def backtest_scores(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(priced(spark, sf_dir), "o_orderkey")
    scores, _ = train.temporal_backtest(df, "y", "o_orderdate", ["o_orderkey"], n_splits=2, estimators=ols(), blend=False)
    wide = scores.groupBy("fold").agg(
        F.max(F.when(F.col("metric") == "root_mean_squared_error", F.col("score"))).alias("rmse"),
        F.max(F.when(F.col("metric") == "mean_absolute_error", F.col("score"))).alias("mae"),
    )
    return rounded(wide, 5)


def purchases(spark, sf_dir):
    """A learnable binary label: value and hour decide, the event type adds noise."""
    df = table(spark, sf_dir, "events")
    strong = (F.col("value") > 60) & (F.hour("ts") < 16)
    return df.select(
        "event_id", "value", "event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"),
        (strong | (F.col("event_type") == "purchase") & (F.dayofmonth("ts") > 20)).cast("int").alias("label"),
    )


def _fit_purchases(spark, sf_dir, **options):
    fit_on, test = splits.train_test_split(purchases(spark, sf_dir), "label", ["event_id"])
    run, board = train.fit(fit_on, "label", ["event_id"], **options)
    return run, board, test


@R.add()
def train_leaderboard(spark, sf_dir):
    run, board, test = _fit_purchases(spark, sf_dir)
    return train.test_leaderboard(run, board, test).drop("fit_time", "pred_time_val")


def _tree():
    return {"DecisionTree": DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=4)}


@R.add("""SELECT event_id, true AS sums_to_one, true AS confidence_is_largest, true AS predicted_is_largest FROM events""")
def batch_score(spark, sf_dir):
    """Every row is scored; probabilities sum to one and the prediction is the largest."""
    run, _, _ = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False)
    scored = run.score(purchases(spark, sf_dir), min_confidence=0.7)
    top = F.greatest("prob_0", "prob_1")
    return scored.select(
        "event_id",
        (F.abs(F.col("prob_0") + F.col("prob_1") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("confidence") == top).alias("confidence_is_largest"),
        ((F.col("label_predicted") == 1) == (F.col("prob_1") > F.col("prob_0"))).alias("predicted_is_largest"),
    )


@R.add("""SELECT event_id, true AS follows_threshold FROM events""")
def decision_threshold(spark, sf_dir):
    run, _, _ = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False, calibrate="f1")
    scored = run.score(purchases(spark, sf_dir))
    follows = (F.col("label_predicted") == 1) == (F.col("prob_1") >= run.threshold)
    return scored.select("event_id", follows.alias("follows_threshold"))


@R.add("""SELECT 'binary' AS problem_type, 'label' AS label, count(*)::BIGINT AS num_rows, 6 AS num_features, 'DecisionTree' AS best_model,
  true AS has_ground_truth FROM events""")
def scoring_summary(spark, sf_dir):
    run, _, _ = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False)
    return train.scoring_summary(run, purchases(spark, sf_dir)).drop("eval_scores")


@R.add()
def model_importance(spark, sf_dir):
    run, _, test = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False)
    return train.feature_importance(run, test, ["event_id"])


@R.add()
def auto_drop(spark, sf_dir):
    """Features left after dropping those without importance and training again."""
    fit_on, test = splits.train_test_split(purchases(spark, sf_dir), "label", ["event_id"])
    results = train.train_with_auto_drop(fit_on, test, "label", ["event_id"], estimators=_tree(), blend=False)
    rows = [(i + 1, f) for i, r in enumerate(results) for f in r["run"].features]
    return spark.createDataFrame(rows, "round int, feature string")


@R.add()
def tune_trials(spark, sf_dir):
    fit_on, _ = splits.train_test_split(purchases(spark, sf_dir), "label", ["event_id"])
    _, trials = train.tune_family(fit_on, "label", ["event_id"], "RF")
    return trials.drop("fit_time")


@R.add()
def model_shap(spark, sf_dir):
    """Exact Shapley values of a logistic model for every customer."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey",
        (F.col("c_acctbal") + 200 * F.col("c_nationkey") > 6000).cast("int").alias("label"),
    )
    model = {"Linear": LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.01)}
    run, _ = train.fit(df, "label", ["c_custkey"], estimators=model, blend=False)
    return explain.shapley_values(
        df, run.features, ["c_custkey"], run.predict, background_rows=20, max_rows=None
    )


@R.add()
def model_pdp(spark, sf_dir):
    run, _, test = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False)
    return explain.partial_dependence(test, run.predict, ["value", "event_type"], ["event_id"], sample_size=None)


@R.add()
def improve_until(spark, sf_dir):
    """Iterations of the train, check, drop loop with their scores."""
    split = splits.train_test_split(purchases(spark, sf_dir), "label", ["event_id"])

    def data(drops):
        return tuple(x.drop(*drops) for x in split)

    out = train.improve_until(
        data, "label", ["event_id"], "balanced_accuracy", 0.9999, 2,
        configurations=[{"estimators": _tree(), "blend": False}],
    )
    rows = [(h["iteration"], ",".join(h["drops"]), h["score"]) for h in out["history"]]
    return spark.createDataFrame(rows, "iteration int, drops string, score double")


# ---- streaming

def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@R.add("""SELECT event_id, value, CASE WHEN value > 60 THEN 1 ELSE 0 END AS predicted,
  round(1 / (1 + exp(-abs(value - 60) / 20)), 6) AS confidence, round(1 / (1 + exp(-abs(value - 60) / 20)), 6) < 0.7 AS flagged_low_confidence FROM events""")
def stream_score(spark, sf_dir):
    """Scored row by row as a stream, written as a table, read back."""

    def score(df):
        odds = F.abs(F.col("value") - 60) / 20
        return df.select(
            "event_id", "value", F.when(F.col("value") > 60, 1).otherwise(0).alias("predicted"),
            F.round(1 / (1 + F.exp(-odds)), 6).alias("confidence"),
        )

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out, state = scratch_path(spark, "scored"), scratch_path(spark, "scored-state")
    query = (
        monitor.score_stream(event_stream(spark, sf_dir), score, 0.7)
        .writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out, format="parquet")
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@R.add("""SELECT event_id, true AS sums_to_one, true AS flag_agrees FROM events""")
def stream_model_score(spark, sf_dir):
    """A fitted model on a stream of raw events."""
    run, _, _ = _fit_purchases(spark, sf_dir, estimators=_tree(), blend=False)
    out, state = scratch_path(spark, "model-scored"), scratch_path(spark, "model-state")
    raw = event_stream(spark, sf_dir).select(
        "event_id", "value", "event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day")
    )
    query = (
        monitor.score_stream(raw, run.score, 0.8)
        .writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out, format="parquet")
    )
    query.awaitTermination()
    return spark.read.parquet(out).select(
        "event_id",
        (F.abs(F.col("prob_0") + F.col("prob_1") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("flagged_low_confidence") == (F.col("confidence") < 0.8)).alias("flag_agrees"),
    )


EDGES10 = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"
STREAM_DRIFT = f"""
WITH t AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-11'),
q AS (SELECT list_sort(list_distinct(quantile_cont(value, {EDGES10}))) AS e FROM t),
b AS (SELECT i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS last FROM q, range(1, 11) r(i) WHERE i < len(e)),
x AS (SELECT i, (SELECT count(*) FROM t WHERE value >= lo AND (value < hi OR (last AND value <= hi))) AS a FROM b),
w AS (SELECT DISTINCT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events),
c AS (SELECT s, b.i, count(value) FILTER (value >= lo AND (value < hi OR (last AND value <= hi))) AS p
  FROM w JOIN events ON time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') = s, b GROUP BY 1, 2),
h AS (SELECT s, greatest(a / sum(a) OVER (PARTITION BY s), 1e-6) AS a, greatest(p / sum(p) OVER (PARTITION BY s), 1e-6) AS p, p AS cnt FROM c JOIN x USING (i))
SELECT s AS window_start, 'value' AS feature, (SELECT count(*) FROM events WHERE time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') = s)::BIGINT AS n,
  sum(cnt)::BIGINT AS in_range_rows, round(sum((p - a) * ln(p / a)), 6) AS psi FROM h GROUP BY s"""


def _profile(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    early = df.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-11")))
    return monitor.training_profile(early, ["value"])


def _report(df):
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return df.select(start, "feature", "n", "in_range_rows", "psi")


@R.add(STREAM_DRIFT)
def windowed_drift(spark, sf_dir):
    """The monitor's plan on a batch table."""
    out = monitor.drift_by_window(table(spark, sf_dir, "events"), "ts", _profile(spark, sf_dir), "7 days")
    return _report(out)


@R.add(STREAM_DRIFT)
def stream_drift(spark, sf_dir):
    """The same windows from a finite replay in complete mode; each batch rewrites the report."""
    out, state = scratch_path(spark, "drift"), scratch_path(spark, "drift-state")
    query = monitor.start_drift_monitor(
        event_stream(spark, sf_dir), "ts", _profile(spark, sf_dir), "7 days", state, "1 day",
        lambda df, _: df.write.mode("overwrite").parquet(out), "complete",
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _report(spark.read.parquet(out))


@R.add("""SELECT o_orderkey, round(0.25 * datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 40.0 * (o_orderstatus = 'F')::INT, 3) AS predicted FROM orders""")
def fit_dates_and_flags(spark, sf_dir):
    """Least squares on a date and a boolean column recovers the line they were made with."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").alias("done")
    )
    age = F.datediff("day", F.lit("1990-01-01").cast("date"))
    df = df.withColumn("y", 0.25 * age + 40.0 * F.col("done").cast("int"))
    run, _ = train.fit(df, "y", ["o_orderkey"], estimators=ols(), blend=False)
    return rounded(run.score(df).select("o_orderkey", F.col("y_predicted").alias("predicted")), 3)


@R.add("""SELECT c_custkey, 'n' || c_nationkey AS predicted FROM customer""")
def fit_text_classes(spark, sf_dir):
    """A text label of 25 classes that one feature decides: a tree finds every class."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_nationkey").cast("string").alias("code")
    )
    tree = {"Tree": DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=25, seed=1)}
    run, _ = train.fit(df, "nation", ["c_custkey"], estimators=tree, blend=False)
    return run.score(df).select("c_custkey", F.col("nation_predicted").alias("predicted"))


@R.add("""SELECT feature, importance FROM (VALUES ('low', 1), ('high', 1), ('noise', 0)) t(feature, importance)""")
def multiclass_importance(spark, sf_dir):
    """Three classes of customers; what separates the lower two counts, what separates none does not."""
    k = F.col("c_nationkey") % 3
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", k.cast("int").alias("group"), (k == 0).cast("double").alias("low"), (k == 2).cast("double").alias("high"),
        (F.col("c_custkey") % 2).cast("double").alias("noise"),
    )
    tree = {"Tree": DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=3, seed=1)}
    run, _ = train.fit(df, "group", ["c_custkey"], estimators=tree, blend=False)
    found = train.feature_importance(run, df, ["c_custkey"])
    return found.select("feature", (F.col("importance") > 0.1).cast("int").alias("importance"))


@R.add(FIT_SCORES)
def train_report_scores(spark, sf_dir):
    """The composed run, profile first: same split and fit, so the same scores."""
    out = report.train_report(priced(spark, sf_dir), "y", ["o_orderkey"], profile_first=True, estimators=ols(), blend=False)
    s = out["test_scores"]
    row = (s["root_mean_squared_error"], s["mean_absolute_error"], s["r2"])
    return rounded(spark.createDataFrame([row], "rmse double, mae double, r2 double"), 5)


LINE = """(SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b, c_acctbal / 500 + 3.0 * c_nationkey AS y FROM customer)"""


def on_a_line(spark, sf_dir):
    a, b = F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), b.alias("b"), (F.col("c_acctbal") / 500 + 3.0 * F.col("c_nationkey")).alias("y"))


@R.add(f"SELECT round(avg(y), 3) AS mean, round(quantile_cont(y, 0.5), 3) AS median, round(min(y), 3) AS min, round(max(y), 3) AS max FROM {LINE}")
def score_report_stats(spark, sf_dir):
    """Scoring with its summaries; the fit is exact, so predictions have the statistics of the truth."""
    df = on_a_line(spark, sf_dir)
    run, _ = train.fit(df, "y", ["c_custkey"], estimators=ols(), blend=False)
    out = report.score_report(run, df, fit_on=df, key=["c_custkey"])
    return rounded(out["prediction_stats"].select("mean", "median", "min", "max"), 3)


@R.add(f"""WITH g AS (SELECT avg(a) AS a, avg(b) AS b FROM (SELECT * FROM {LINE} ORDER BY md5(concat_ws('|', c_custkey, '42')), c_custkey LIMIT 20))
SELECT c_custkey, 'a' AS feature, round(2.0 * (l.a - g.a), 6) AS shap_value FROM {LINE} l, g
UNION ALL SELECT c_custkey, 'b', round(3.0 * (l.b - g.b), 6) FROM {LINE} l, g""")
def linear_model_shap(spark, sf_dir):
    """Shapley values of a fitted line: slope times distance from the background's mean."""
    df = on_a_line(spark, sf_dir)
    run, _ = train.fit(df, "y", ["c_custkey"], estimators=ols(), blend=False)
    out = explain.shapley_values(df, run.features, ["c_custkey"], run.predict, background_rows=20)
    return rounded(out.select("c_custkey", "feature", "shap_value"), 6)


@R.add(f"""SELECT position::INT AS position, round(2.0 * (lo + (hi - lo) * position / 19) + 3.0 * b, 3) AS pdp
FROM (SELECT min(a) AS lo, max(a) AS hi, avg(b) AS b FROM {LINE}), range(20) t(position)""")
def linear_model_pdp(spark, sf_dir):
    df = on_a_line(spark, sf_dir)
    run, _ = train.fit(df, "y", ["c_custkey"], estimators=ols(), blend=False)
    return rounded(explain.partial_dependence(df, run.predict, ["a"], ["c_custkey"]).select("position", "pdp"), 3)


@R.add("SELECT feature FROM (VALUES ('a'), ('b')) t(feature)")
def linear_auto_drop(spark, sf_dir):
    """A column without influence is dropped, the two that make the label stay."""
    df = on_a_line(spark, sf_dir).withColumn("idle", (F.col("c_custkey") % 5).cast("double"))
    fit_on, test = splits.train_test_split(df, "y", ["c_custkey"], stratify=False)
    last = train.train_with_auto_drop(fit_on, test, "y", ["c_custkey"], estimators=ols(), blend=False)[-1]
    return spark.createDataFrame([(f,) for f in last["run"].features], "feature string")


@R.add(f"""WITH g AS (SELECT avg(a) AS a, avg(b) AS b FROM {LINE})
SELECT c_custkey, 'a' AS feature, round(2.0 * (l.a - g.a), 6) AS shap_value FROM {LINE} l, g
UNION ALL SELECT c_custkey, 'b', round(3.0 * (l.b - g.b), 6) FROM {LINE} l, g""")
def linear_shap_all_rows(spark, sf_dir):
    """The fitted line against the whole table as background."""
    df = on_a_line(spark, sf_dir)
    run, _ = train.fit(df, "y", ["c_custkey"], estimators=ols(), blend=False)
    out = shapley.model_shapley(df, run, ["c_custkey"])
    return rounded(out.select("c_custkey", "feature", "shap_value"), 6)


FLAGS = ["urgent", "done", "late"]
STEPS = """(SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS urgent, (o_orderstatus = 'F')::INT AS done,
  (month(o_orderdate) > 8)::INT AS late FROM orders)"""


def tree_shap_sql():
    """Every coalition of three flags, over their distinct combinations and how many rows have each."""
    of = [f"CASE WHEN s & {1 << i} > 0 THEN x.{f} ELSE z.{f} END" for i, f in enumerate(FLAGS)]
    value = "(2.0::DOUBLE * ({0}) * ({1}) + 1.5 * ({2}) + 0.5 * ({0}) + 0.25 * ({1}) * ({2}))".format(*of)
    weights = "[1/3.0::DOUBLE, 1/6.0::DOUBLE, 1/3.0::DOUBLE]"
    parts = " UNION ALL ".join(
        f"""SELECT urgent, done, late, '{f}' AS feature, sum(v * CASE WHEN s & {1 << i} > 0 THEN {weights}[bit_count(s::BIGINT)]
  ELSE -{weights}[bit_count(s::BIGINT) + 1] END) AS shap_value FROM v GROUP BY 1, 2, 3"""
        for i, f in enumerate(FLAGS)
    )
    return f"""WITH o AS (SELECT * FROM {STEPS}), k AS (SELECT urgent, done, late, count(*) AS n FROM o GROUP BY 1, 2, 3),
v AS (SELECT x.urgent, x.done, x.late, s, sum(z.n * {value}) / sum(z.n) AS v FROM k x, k z, range(8) t(s) GROUP BY 1, 2, 3, 4)
SELECT o_orderkey, feature, round(shap_value, 6) AS shap_value FROM o JOIN ({parts}) p USING (urgent, done, late)"""


@R.add(tree_shap_sql())
def tree_shap_all_rows(spark, sf_dir):
    """A tree that meets its labels exactly, against the whole table as background."""
    flags = [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", F.month("o_orderdate") > 8]
    df = table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("int").alias(f) for c, f in zip(flags, FLAGS, strict=True)])
    u, d, late = (F.col(f) for f in FLAGS)
    df = df.withColumn("y", 2.0 * u * d + 1.5 * late + 0.5 * u + 0.25 * d * late)
    tree = {"Tree": DecisionTreeRegressor(featuresCol="_features", labelCol="_label", maxDepth=3)}
    run, _ = train.fit(df, "y", ["o_orderkey"], forced_type="regression", estimators=tree, blend=False)
    out = shapley.model_shapley(df, run, ["o_orderkey"])
    return rounded(out.select("o_orderkey", "feature", "shap_value"), 6)


@R.add()
def forest_shap(spark, sf_dir):
    """Shapley values of a forest for every customer, every customer as background."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") * F.sqrt(F.col("c_nationkey") + 1.0)).alias("worth"))
    run, _ = train.fit(df, "worth", ["c_custkey"], estimators={"Forest": RandomForestRegressor(featuresCol="_features", labelCol="_label", seed=42)}, blend=False)
    return shapley.model_shapley(df, run, ["c_custkey"])


@R.add("""WITH q AS (SELECT unnest([0.1, 0.5, 0.9]) AS level, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) AS fitted FROM orders)
SELECT level::DOUBLE AS level, round(fitted, 4) AS fitted, round(avg(greatest(level * (o_totalprice - fitted), (level - 1) * (o_totalprice - fitted))), 4) AS pinball_loss,
  round(avg((o_totalprice <= fitted)::INT), 4) AS coverage, count(*) AS rows FROM orders, q GROUP BY level, fitted""")
def quantile_levels(spark, sf_dir):
    """The fit on a feature that says nothing is the plain quantile."""
    priced_orders = table(spark, sf_dir, "orders").select(F.lit(1.0).alias("one"), F.col("o_totalprice").alias("_label"))
    ready = VectorAssembler(inputCols=["one"], outputCol="_features").transform(priced_orders)
    out = None
    for level in (0.1, 0.5, 0.9):
        scored = quantile.LinearQuantile(level).fit(ready).transform(ready)
        scored = scored.withColumns({"level": F.lit(level), "fitted": F.round("prediction", 4)})
        row = quantile.quantile_scores(scored, "_label", "prediction", level, ["level", "fitted"])
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


@R.add(f"""SELECT l_quantity, round(avg(greatest(0.8 * residual, -0.2 * residual)), 3) AS pinball_loss, round(avg((residual <= 0)::INT), 5) AS coverage, count(*) AS rows
FROM ({REGRESSION_SQL}) GROUP BY 1""")
def quantile_scores(spark, sf_dir):
    scored = quantile.quantile_scores(scored_regression(spark, sf_dir), "actual", "predicted", 0.8, ["l_quantity"])
    return rounded(rounded(scored, 3, ["pinball_loss"]), 5, ["coverage"])


@R.add()
def quantile_run(spark, sf_dir):
    """Price at the 0.9 level from its month: leaderboard of the quantile candidates on test rows."""
    fit_on, test = splits.train_test_split(priced(spark, sf_dir), "y", ["o_orderkey"], stratify=False)
    run, board = train.fit(fit_on, "y", ["o_orderkey"], forced_type="quantile", quantile_level=0.9)
    return train.test_leaderboard(run, board, test).drop("fit_time", "pred_time_val")
