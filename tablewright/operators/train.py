"""Training, scoring and tuning on MLlib.

A run fits a small set of candidate estimators on the same assembled table, ranks them on a
held-out slice in hash order, optionally blends them, and scores the test table. Scores
come from the evaluation operators, so no prediction ever leaves the cluster.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import constants as K
from tablewright.functions.schema import (
    categorical_columns,
    col,
    drop_columns,
    label_values,
    numeric_columns,
    require_columns,
)
from tablewright.operators import evaluate, forest, quantile
from tablewright.operators.errors import flag_low_confidence, predicted_probability
from tablewright.operators.explain import auc_score, permutation_importance
from tablewright.operators.splits import aggregate_scores, assign_folds, assign_test, fold_pairs
from tablewright.plans.attach import spread_for_passes

MAX_CLASSES = 1_000
MAX_INDEXED_CATEGORIES = 1_000
HASHED_WIDTH = 256
VALIDATION_FRACTION = 0.2
#: Above so many rows candidates are fitted one after the other: each keeps bagged rows in memory, and has work for all cores.
SIDE_BY_SIDE_ROWS = 2_000_000

# Family names accepted by the tuner and the estimator that stands for each.
FAMILIES = {"GBM": "boost", "XGB": "boost", "CAT": "boost", "RF": "forest", "XT": "forest"}
# Metrics per problem type; errors are negated in leaderboards so that higher is better.
CLASS_METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "mcc", "log_loss")
BINARY_METRICS = ("f1", "roc_auc", *CLASS_METRICS)
REGRESSION_METRICS = ("root_mean_squared_error", "mean_absolute_error", "r2")
QUANTILE_METRICS = ("pinball_loss", *REGRESSION_METRICS)
LOWER_IS_BETTER = ("log_loss", "root_mean_squared_error", "mean_absolute_error", "pinball_loss")


def problem_type(df: DataFrame, label: str, forced: str | None = None) -> str:
    """binary, multiclass or regression; ``quantile``, fitted on the pinball loss, only when forced."""
    if forced is not None:
        if forced not in ("binary", "multiclass", "regression", "quantile"):
            raise ValueError(f"Unsupported problem type: {forced}")
        return forced
    return _kind_of(len(label_values(df, label, K.CLASSIFICATION_MAX_CLASSES + 1)), label in numeric_columns(df))


def _kind_of(n_classes: int, numeric: bool) -> str:
    """Only a number can be regressed on, however many values the label has."""
    if numeric and n_classes > K.CLASSIFICATION_MAX_CLASSES:
        return "regression"
    return "binary" if n_classes == 2 else "multiclass"


def default_metric(kind: str) -> str:
    named = {"quantile": "pinball_loss", "regression": "root_mean_squared_error"}
    return named.get(kind, "accuracy")


def preparation(df: DataFrame, features: Sequence[str]) -> list:
    """Impute numbers, index and encode categories; near-unique text is hashed to a fixed width.

    Booleans become 0 and 1, dates their day number, month and weekday, timestamps also their time of day, all
    imputed like numbers. The category limit is checked first, since an indexer keeps every category on the driver.
    """
    numeric = [f for f in numeric_columns(df) if f in features]
    text = [f for f in categorical_columns(df) if f in features and isinstance(df.schema[f].dataType, T.StringType)]
    derived = {
        name: sql for f in features if f in categorical_columns(df) for name, sql in _as_numbers(f, df.schema[f].dataType).items()
    }
    stages, parts = [], []
    if derived:
        made = ", ".join(f"{sql} AS `{name}`" for name, sql in derived.items())
        stages.append(SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"))
        numeric = [*numeric, *derived]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"_i_{c}" for c in numeric]))
        parts += [f"_i_{c}" for c in numeric]
    if text:
        sizes = df.agg(*[F.approx_count_distinct(col(c)) for c in text]).first()
        small = [c for c, n in zip(text, sizes, strict=True) if n <= MAX_INDEXED_CATEGORIES]
        large = [c for c in text if c not in small]
        if small:
            stages.append(
                StringIndexer(inputCols=small, outputCols=[f"_x_{c}" for c in small], handleInvalid="keep")
            )
            stages.append(
                OneHotEncoder(inputCols=[f"_x_{c}" for c in small], outputCols=[f"_o_{c}" for c in small])
            )
            parts += [f"_o_{c}" for c in small]
        if large:
            stages.append(FeatureHasher(inputCols=large, outputCol="_hashed", numFeatures=HASHED_WIDTH))
            parts.append("_hashed")
    if not parts:
        raise ValueError("no usable feature columns")
    stages.append(VectorAssembler(inputCols=parts, outputCol="_features", handleInvalid="keep"))
    return stages


def with_values(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that have a value in some row; NaN is none. A median or category can't come from an empty column."""
    if not features:
        return []
    kinds = {f: df.schema[f].dataType for f in features}
    known = [F.count(F.nanvl(col(f), F.lit(None)) if isinstance(k, (T.DoubleType, T.FloatType)) else col(f)) for f, k in kinds.items()]
    counts = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(known)]).first()
    return [f for f, n in zip(features, counts, strict=True) if n]


def _as_numbers(name: str, kind: T.DataType) -> dict[str, str]:
    """SQL of the numbers that stand for a boolean or a date."""
    c = f"`{name}`"
    if isinstance(kind, T.BooleanType):
        return {f"_n_{name}": f"CAST(CAST({c} AS INT) AS DOUBLE)"}
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {}
    out = {
        f"_n_{name}": f"CAST(DATEDIFF(CAST({c} AS DATE), DATE'1970-01-01') AS DOUBLE)",
        f"_n_{name}_month": f"CAST(MONTH({c}) AS DOUBLE)",
        f"_n_{name}_weekday": f"CAST(WEEKDAY({c}) AS DOUBLE)",
    }
    if not isinstance(kind, T.DateType):
        out[f"_n_{name}_hour"] = f"HOUR({c}) + MINUTE({c}) / 60.0D"
    return out


def candidates(kind: str, seed: int = K.SEED, quick: bool = False, level: float = 0.5) -> dict[str, object]:
    """Estimators fitted by a run; boosting needs one-vs-rest on more than two classes."""
    trees, rounds, depth = (10, 5, 4) if quick else (50, 30, 5)
    f = {"featuresCol": "_features", "labelCol": "_label"}
    if kind == "quantile":
        return quantile.candidates(level, seed, quick)
    if kind == "regression":
        return {
            "Linear": LinearRegression(**f, regParam=0.01),
            "RandomForest": RandomForestRegressor(**f, numTrees=trees, maxDepth=depth, seed=seed),
            "GradientBoosting": GBTRegressor(**f, maxIter=rounds, maxDepth=depth, seed=seed),
            "DecisionTree": DecisionTreeRegressor(**f, maxDepth=depth, seed=seed),
        }
    out = {
        "Linear": LogisticRegression(**f, regParam=0.01, maxIter=20 if quick else 50),
        "RandomForest": RandomForestClassifier(**f, numTrees=trees, maxDepth=depth, seed=seed),
        "DecisionTree": DecisionTreeClassifier(**f, maxDepth=depth, seed=seed),
    }
    boost = GBTClassifier(**f, maxIter=rounds, maxDepth=depth, seed=seed)
    out["GradientBoosting"] = boost if kind == "binary" else OneVsRest(classifier=boost, **f)
    return out


@dataclass
class Fitted:
    """A run's models. ``weights`` are the blend weights; only ``best`` is used without a blend."""

    label: str
    kind: str
    metric: str
    features: list[str]
    classes: list
    prepare: PipelineModel
    models: dict[str, object]
    best: str = ""
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float | None = None
    level: float | None = None

    def info(self) -> dict:
        out = {
            "problem_type": self.kind,
            "eval_metric": self.metric,
            "label": self.label,
            "features": self.features,
            "best_model": self.best,
        }
        if self.threshold is not None:
            out["decision_threshold"] = self.threshold
        if self.level is not None:
            out["quantile_level"] = self.level
        return out

    def _value(self, df: DataFrame, model: str, out: str) -> DataFrame:
        """Add ``out``: class probabilities as an array, or the predicted value."""
        scored = self.models[model].transform(df)
        temp = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
        if not self.classes:
            value = F.col("prediction")
        elif "probability" in scored.columns:
            value = vector_to_array("probability")
        else:
            # one-against-the-rest margins of boosted trees, as probabilities that add up to one
            chance = F.transform(vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
            total = F.aggregate(chance, F.lit(0.0), lambda a, x: a + x)
            value = F.transform(chance, lambda x: x / total)
        return scored.withColumn(out, value).drop(*temp)

    def _values(self, df: DataFrame, models: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
        """Score ``models`` in one pass; returns the table and one value expression per model."""
        single = [m for m in self.models if m in models or ("Blend" in models and m in self.weights)]
        scored = self.prepare.transform(df)
        for i, name in enumerate(single):
            scored = self._value(scored, name, f"_value{i}")
        scored = scored.select(*[col(c) for c in df.columns], *[f"_value{i}" for i in range(len(single))])
        values = {name: F.col(f"_value{i}") for i, name in enumerate(single)}
        if "Blend" in models:
            total = sum(self.weights.values())
            shares = [(values[m], F.lit(w / total)) for m, w in self.weights.items()]
            if self.classes:
                parts = [
                    sum((F.get(v, F.lit(k)) * w for v, w in shares), F.lit(0.0))
                    for k in range(len(self.classes))
                ]
                values["Blend"] = F.array(*parts)
            else:
                values["Blend"] = sum((v * w for v, w in shares), F.lit(0.0))
        return scored, {m: values[m] for m in models}

    def outputs(self, df: DataFrame) -> DataFrame:
        """Add ``_value`` of the best model: class probabilities in class order, or the predicted value."""
        return self._outputs(df, self.best)

    def _outputs(self, df: DataFrame, model: str) -> DataFrame:
        scored, values = self._values(df, [model])
        out = scored.withColumn("_value", values[model])
        return out.select(*[col(c) for c in df.columns], "_value")

    def _pick(self, value: Column, cut: float | None) -> Column:
        """Predicted class of a probability array; the cutoff is used for two classes only."""
        if self.kind == "binary" and cut is not None:
            return F.when(F.get(value, F.lit(1)) >= cut, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
        values = F.array(*[F.lit(c) for c in self.classes])
        return F.get(values, (F.array_position(value, F.array_max(value)) - 1).cast("int"))

    def predict(self, df: DataFrame, model: str | None = None, of_class: object = None) -> DataFrame:
        """Add numeric ``prediction``: probability of ``of_class`` (the highest by default), or the predicted value."""
        out = self._outputs(df, model or self.best)
        at = len(self.classes) - 1 if of_class is None else self.classes.index(of_class)
        value = F.col("_value") if not self.classes else F.get("_value", F.lit(at))
        return out.withColumn("prediction", value).drop("_value")

    def score(
        self,
        df: DataFrame,
        model: str | None = None,
        decision_threshold: float | None = None,
        min_confidence: float | None = None,
    ) -> DataFrame:
        """Add ``<label>_predicted``, and for classes ``prob_<class>`` and ``confidence``.

        Works on streaming tables too. The threshold is used for binary labels only.
        """
        out = self._outputs(df, model or self.best)
        name = f"{self.label}_predicted"
        if not self.classes:
            return out.withColumnRenamed("_value", name)
        cut = decision_threshold if decision_threshold is not None else self.threshold
        named = {f"prob_{c}": F.get("_value", F.lit(i)) for i, c in enumerate(self.classes)}
        out = out.withColumns({**named, name: self._pick(F.col("_value"), cut)}).drop("_value")
        out = out.withColumn("confidence", predicted_probability(out.select(*named, name), name))
        return flag_low_confidence(out, min_confidence)

    def scored_table(self, df: DataFrame, model: str | None = None) -> DataFrame:
        """``actual, predicted`` and probabilities or residual, next to the input columns."""
        out = self.score(df, model).withColumnsRenamed({f"{self.label}_predicted": "predicted"})
        out = out.withColumn("actual", col(self.label))
        return out if self.classes else out.withColumn("residual", F.col("actual") - F.col("predicted"))

    def evaluate_models(
        self, df: DataFrame, models: Sequence[str], metrics: Sequence[str] | None = None
    ) -> dict[str, dict[str, float]]:
        """Metrics per model; all models are scored and aggregated in one pass over ``df``.

        Only ROC AUC, which needs its own score table, adds a pass per model.
        """
        scored, values = self._values(df, list(models))
        truth = col(self.label)
        if not self.classes:
            y = truth.cast("double")

            def errors(v: Column) -> list[Column]:
                out = [
                    F.sqrt(F.avg((y - v) ** 2)).alias("root_mean_squared_error"),
                    F.avg(F.abs(y - v)).alias("mean_absolute_error"),
                    evaluate.r2_score(y, y - v).alias("r2"),
                ]
                return out if self.level is None else [*out, F.avg(quantile.pinball(y, v, self.level)).alias("pinball_loss")]

            row = scored.agg(*[F.struct(*errors(v)).alias(f"m{i}") for i, v in enumerate(values.values())]).first()
            return {m: {k: float(x) for k, x in row[i].asDict().items()} for i, m in enumerate(values)}
        index = F.array_position(F.array(*[F.lit(c) for c in self.classes]), truth) - 1
        cells = [
            F.struct(
                F.lit(m).alias("model"),
                self._pick(v, self.threshold).alias("predicted"),
                F.coalesce(F.get(v, index.cast("int")), F.lit(0.0)).alias("q"),
            )
            for m, v in values.items()
        ]
        long = scored.select(truth.alias("actual"), F.inline(F.array(*cells)))
        out = self._class_scores(long)
        if self.kind == "binary" and (metrics is None or "roc_auc" in metrics):
            for m, v in values.items():
                ranked = scored.select(truth.alias("actual"), F.get(v, F.lit(1)).alias("score"))
                area = evaluate.roc_auc(
                    evaluate.threshold_table(ranked, "actual", "score", self.classes[1])
                ).first()[0]
                if area is not None:
                    out[m]["roc_auc"] = float(area)
        return out

    def _class_scores(self, long: DataFrame, rows: Column | None = None) -> dict[str, dict[str, float]]:
        """Metrics per model of ``model, actual, predicted`` and ``q``, the chance given to the actual class."""
        positive = evaluate.class_key(F.lit(self.classes[1]), long.schema["actual"].dataType) if self.kind == "binary" else None
        table = evaluate.classification_scores(long, prob_of_actual=F.col("q"), positive=positive, by=["model"], rows=rows)
        return {r["model"]: {k: float(x) for k, x in r.asDict().items() if k != "model" and x is not None} for r in table.collect()}

    def evaluate(self, df: DataFrame, model: str | None = None, metrics: Sequence[str] | None = None) -> dict[str, float]:
        model = model or self.best
        return self.evaluate_models(df, [model], metrics)[model]

    def signed(self, scores: Mapping[str, float]) -> float:
        value = scores[self.metric]
        return -value if self.metric in LOWER_IS_BETTER else value


def _with_label(df: DataFrame, label: str, classes: list) -> DataFrame:
    if not classes:
        return df.withColumn("_label", col(label).cast("double"))
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label)) - 1
    return df.withColumn("_label", index.cast("double"))


def fit(
    train: DataFrame,
    label: str,
    key: Sequence[str],
    forced_type: str | None = None,
    eval_metric: str | None = None,
    estimators: Mapping[str, object] | None = None,
    blend: bool = True,
    calibrate: str | None = None,
    seed: int = K.SEED,
    quick: bool = False,
    quantile_level: float = 0.5,
    time_limit: float | None = None,
    parallelism: int = 1,
    only_best: bool = False,
) -> tuple[Fitted, DataFrame]:
    """Fit the candidates and rank them on a validation slice of ``train``.

    With ``time_limit`` no further candidate is fitted after so many seconds; the first one always is.
    ``parallelism`` candidates are fitted side by side, on tables of up to ``SIDE_BY_SIDE_ROWS`` rows; their times then
    hold what they wait for each other.
    With ``only_best`` the run keeps one model, that of the earliest of equally good candidates. If all candidates are
    then forests of classes, without a blend or a calibration, they are grown together (:mod:`tablewright.operators.forest`)
    and each has the time of all; with ``time_limit`` they are grown one after the other, with the same trees.
    ``quantile_level`` is the level of a run with ``forced_type="quantile"``, whose label has to be a number.
    Returns the run and its leaderboard ``model, score_val, fit_time, pred_time_val``.
    """
    require_columns(train, [label, *key], "fit")
    known = train.where(col(label).isNotNull())
    found = label_values(known, label, MAX_CLASSES + 1)
    kind = problem_type(known, label, forced_type) if forced_type else _kind_of(len(found), label in numeric_columns(train))
    metric = eval_metric or default_metric(kind)
    allowed = {"binary": BINARY_METRICS, "multiclass": CLASS_METRICS, "quantile": QUANTILE_METRICS}.get(kind, REGRESSION_METRICS)
    if metric not in allowed:
        raise ValueError(f"'{metric}' is not a metric for {kind}: {allowed}")
    if kind == "quantile" and label not in numeric_columns(train):
        raise ValueError(f"quantiles need a number, '{label}' is none")
    level = quantile.check_level(quantile_level) if kind == "quantile" else None
    classes: list = []
    if kind in ("binary", "multiclass"):
        classes = sorted(found)
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"'{label}' has more than {MAX_CLASSES} classes")
    features = [
        c
        for c in train.columns
        if c in {*numeric_columns(train), *categorical_columns(train)} and c not in {label, *key}
    ]
    chosen = estimators if estimators is not None else candidates(kind, seed, quick, quantile_level)
    together = only_best and not blend and calibrate is None and forest.can_share(chosen, len(classes))
    split = assign_test(known, key, label if classes else None, VALIDATION_FRACTION, seed)
    if together:
        split = split.select(*[col(c) for c in dict.fromkeys([label, *key, *features])], "is_test").persist()
    try:
        # medians and categories of the rows that are fitted on; the validation slice only passes through
        fitting = split.where("NOT is_test").drop("is_test")
        features = with_values(fitting, features)
        prepare = Pipeline(stages=preparation(fitting, features)).fit(fitting)
        run = Fitted(label, kind, metric, features, classes, prepare, {}, level=level)
        board = _ranked_forests(run, split, chosen, time_limit) if together else []
        if not board:
            board = _ranked(run, split, key, chosen, blend, calibrate, time_limit, parallelism)
            if only_best:
                score = {row[0]: row[1] for row in board}
                run.best = max([n for n in chosen if n in score], key=score.get)
                run.models = {run.best: run.models[run.best]}
    finally:
        if together:
            split.unpersist()
    leaderboard = train.sparkSession.createDataFrame(
        board, "model string, score_val double, fit_time double, pred_time_val double"
    )
    return run, leaderboard


def _ranked(
    run: Fitted,
    split: DataFrame,
    key: Sequence[str],
    chosen: Mapping[str, object],
    blend: bool,
    calibrate: str | None,
    time_limit: float | None,
    parallelism: int,
) -> list[tuple]:
    """Fit ``chosen`` into ``run``, each by itself; returns its leaderboard, best first."""
    classes, metric = run.classes, run.metric
    rows = split.count()
    laid = spread_for_passes(split, key, rows)
    ready = run.prepare.transform(_with_label(laid, run.label, classes)).select("is_test", "_label", "_features").persist()
    slice_rows = laid.where("is_test").drop("is_test").persist()
    try:
        started = time.perf_counter()

        def one(at: int, name: str, est) -> tuple | None:
            if at and time_limit is not None and time.perf_counter() - started > time_limit:
                return None
            begin = time.perf_counter()
            model = est.fit(ready.where("NOT is_test"))
            fitted = time.perf_counter()
            value = run.signed(replace(run, models={name: model}).evaluate(slice_rows, name, [metric]))
            return model, (name, value, fitted - begin, time.perf_counter() - fitted)

        todo = [(i, name, est) for i, (name, est) in enumerate(chosen.items())]
        if parallelism > 1 and rows <= SIDE_BY_SIDE_ROWS:
            with ThreadPool(parallelism) as pool:
                done = pool.starmap(inheritable_thread_target(split.sparkSession)(one), todo, chunksize=1)
        else:
            done = [one(*t) for t in todo]
        board = [row for _, row in filter(None, done)]
        run.models = {row[0]: model for model, row in filter(None, done)}
        board.sort(key=lambda r: (-r[1], r[0]))
        run.best = board[0][0]
        if blend and len(board) > 1:
            # better than the weakest member by more counts for more
            low = board[-1][1]
            run.weights = {n: (v - low) / ((board[0][1] - low) or 1.0) + 0.1 for n, v, _, _ in board}
            begin = time.perf_counter()
            value = run.signed(run.evaluate(slice_rows, "Blend", [metric]))
            board.append(("Blend", value, sum(r[2] for r in board), time.perf_counter() - begin))
            board.sort(key=lambda r: (-r[1], r[0]))
            run.best = board[0][0]
        if calibrate and run.kind == "binary":
            scored = run.scored_table(slice_rows)
            table = evaluate.threshold_table(scored, "actual", f"prob_{classes[1]}", classes[1])
            run.threshold = evaluate.calibrate_threshold(table, calibrate).first()["threshold"]
    finally:
        ready.unpersist()
        slice_rows.unpersist()
    return board


def _ranked_forests(run: Fitted, split: DataFrame, chosen: Mapping[str, object], time_limit: float | None) -> list[tuple]:
    """:func:`_ranked` for forests that share their cells; nothing when the counts of a node are too large to be shared."""
    ready = run.prepare.transform(_with_label(split, run.label, run.classes)).select("is_test", "_label", "_features")
    started = time.perf_counter()
    search = forest.Search(ready, len(run.classes))
    if search.node_bytes(chosen) > forest.NODE_BYTES:
        return []
    board, best = [], None
    for names in [list(chosen)] if time_limit is None else [[n] for n in chosen]:
        begin = time.perf_counter()
        if board and begin - started > time_limit:
            break
        search.grow({n: chosen[n] for n in names})
        fitted = time.perf_counter()
        scores = _forest_scores(run, search.scored(), split.schema[run.label].dataType, names)
        ended = time.perf_counter()
        board += [(n, run.signed(scores[n]), fitted - begin, ended - fitted) for n in names]
        first = max(board, key=lambda r: r[1])[0]
        if first != best:
            best = first
            run.models = {best: search.model(split.sparkSession, best, chosen[best])}
    run.best = best
    return sorted(board, key=lambda r: (-r[1], r[0]))


def _forest_scores(run: Fitted, scored: DataFrame, dtype: T.DataType, names: Sequence[str]) -> dict[str, dict[str, float]]:
    """The metric of the run for every forest, from counted rows with their class probabilities."""
    classes = F.array(*[F.lit(c) for c in run.classes])
    value = F.col("value")
    long = scored.select(
        "model", F.get(classes, F.col("y")).cast(dtype).alias("actual"), run._pick(value, None).alias("predicted"),
        F.get(value, F.col("y")).alias("q"), F.get(value, F.lit(1)).alias("score"), "n",
    )
    if run.metric != "roc_auc":
        return run._class_scores(long, F.col("n"))
    out = {}
    long = long.persist()
    try:
        for name in names:
            ranked = long.where(F.col("model") == name)
            table = evaluate.threshold_table(ranked, "actual", "score", run.classes[1], rows=F.col("n"))
            out[name] = {"roc_auc": float(evaluate.roc_auc(table).first()[0])}
    finally:
        long.unpersist()
    return out


def test_leaderboard(run: Fitted, leaderboard: DataFrame, test: DataFrame) -> DataFrame:
    """Leaderboard with ``score_test``, best test score first."""
    rows = test.where(col(run.label).isNotNull())
    names = [r["model"] for r in leaderboard.collect()]
    scores = [(m, run.signed(s)) for m, s in run.evaluate_models(rows, names, [run.metric]).items()]
    tested = test.sparkSession.createDataFrame(scores, "model string, score_test double")
    return leaderboard.join(tested, "model").orderBy(F.desc("score_test"), "model")


test_leaderboard.__test__ = False


def score_expression(run: Fitted, cut: float = 0.5) -> Column:
    """Aggregate used for permutation importance, over ``_value`` of :meth:`Fitted.outputs`; higher is better.

    It is the run's metric: counts per class for the label metrics, negative errors for regression. ROC AUC is not
    an aggregate of rows: see :func:`feature_importance`.
    """
    truth, value = col(run.label), F.col("_value")
    if not run.classes:
        gap = truth.cast("double") - value
        if run.metric == "mean_absolute_error":
            return -F.avg(F.abs(gap))
        if run.metric == "pinball_loss":
            return -F.avg(quantile.pinball(truth.cast("double"), value, run.level))
        return evaluate.r2_score(truth.cast("double"), gap) if run.metric == "r2" else -F.sqrt(F.avg(gap**2))
    said = run._pick(value, cut if run.threshold is None else run.threshold)
    if run.metric == "roc_auc":
        raise ValueError("roc_auc is no aggregate of rows")
    if run.metric == "log_loss":
        at = F.array_position(F.array(*[F.lit(c) for c in run.classes]), truth) - 1
        return F.avg(F.log(F.greatest(F.coalesce(F.get(value, at.cast("int")), F.lit(0.0)), F.lit(1e-15))))
    if run.metric == "accuracy":
        return F.avg((said == truth).cast("double"))
    hit = [F.count_if((said == F.lit(c)) & (truth == F.lit(c))).cast("double") for c in run.classes]
    real = [F.count_if(truth == F.lit(c)).cast("double") for c in run.classes]
    called = [F.count_if(said == F.lit(c)).cast("double") for c in run.classes]
    n = F.count(truth).cast("double")
    if run.metric == "mcc":
        cross = sum((p * t for p, t in zip(called, real, strict=True)), F.lit(0.0))
        spread = F.sqrt((n * n - sum((p * p for p in called), F.lit(0.0))) * (n * n - sum((t * t for t in real), F.lit(0.0))))
        return F.coalesce(F.try_divide(sum(hit, F.lit(0.0)) * n - cross, spread), F.lit(0.0))
    if run.metric == "balanced_accuracy":
        shares = [F.try_divide(h, t) for h, t in zip(hit, real, strict=True)]
        found = sum((F.when(t > 0, 1.0).otherwise(0.0) for t in real), F.lit(0.0))
        return F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in shares), F.lit(0.0)), found)
    f1 = [F.coalesce(F.try_divide(2 * h, t + p), F.lit(0.0)) for h, t, p in zip(hit, real, called, strict=True)]
    if run.metric == "f1":
        return f1[1]
    if run.metric == "f1_weighted":
        return F.try_divide(sum((x * t for x, t in zip(f1, real, strict=True)), F.lit(0.0)), n)
    return sum(f1, F.lit(0.0)) / len(f1)


def feature_importance(
    run: Fitted, test: DataFrame, key: Sequence[str], repeats: int = 1, seed: int = K.SEED
) -> DataFrame:
    """Permutation importance of the best model on test rows, most important first."""
    rows = test.where(col(run.label).isNotNull())
    if run.metric == "roc_auc":
        score = auc_score(rows, run.outputs, run.label, run.classes[1], F.get("_value", F.lit(1)))
    else:
        score = score_expression(run)
    table = permutation_importance(rows, run.features, key, run.outputs, score, repeats, seed)
    return table.orderBy(F.desc("importance"), "feature")


def low_importance(importance: DataFrame) -> DataFrame:
    """Features at or below 0.001, with ``negative`` marking the harmful ones."""
    return importance.where(F.col("importance") <= K.LOW_IMPORTANCE).select(
        "feature", "importance", (F.col("importance") < 0).alias("negative")
    )


def train_and_evaluate(
    train: DataFrame, test: DataFrame, label: str, key: Sequence[str], **options
) -> dict[str, object]:
    """One run: models, both leaderboards, test scores and permutation importance."""
    run, board = fit(train, label, key, **options)
    rows = test.where(col(label).isNotNull())
    return {
        "run": run,
        "info": run.info(),
        "leaderboard": board,
        "leaderboard_test": test_leaderboard(run, board, rows),
        "test_scores": run.evaluate(rows),
        "importance": feature_importance(run, rows, key),
    }


def train_with_auto_drop(
    train: DataFrame, test: DataFrame, label: str, key: Sequence[str], dropped: Sequence[str] = (), **options
) -> list[dict[str, object]]:
    """Train, drop the low-importance features not dropped before, train again (if there are any)."""
    first = train_and_evaluate(
        drop_columns(train, dropped, [label, *key]), drop_columns(test, dropped, [label, *key]), label, key, **options
    )
    low = [r["feature"] for r in low_importance(first["importance"]).collect() if r["feature"] not in dropped]
    if not low or len(low) >= len(first["run"].features):
        return [first]
    drop = [*dropped, *low]
    second = train_and_evaluate(drop_columns(train, drop), drop_columns(test, drop), label, key, **options)
    return [first, {**second, "dropped": low}]


def _score_rows(fold: int, scores: Mapping[str, float]) -> list[tuple]:
    return [(fold, m, float(v)) for m, v in sorted(scores.items())]


def cross_validate(
    df: DataFrame, label: str, key: Sequence[str], folds: int = 5, seed: int = K.SEED, **options
) -> tuple[DataFrame, DataFrame]:
    """Separate fit per fold; returns ``fold, metric, score`` rows and their aggregate."""
    known = df.where(col(label).isNotNull())
    classes = problem_type(known, label, options.get("forced_type")) in ("binary", "multiclass")
    marked = assign_folds(known, key, folds, label if classes else None, seed, column="_cv").persist()
    rows = []
    try:
        for f in range(folds):
            run, _ = fit(marked.where(F.col("_cv") != f).drop("_cv"), label, key, seed=seed, **options)
            rows += _score_rows(f + 1, run.evaluate(marked.where(F.col("_cv") == f).drop("_cv")))
    finally:
        marked.unpersist()
    scores = df.sparkSession.createDataFrame(rows, "fold int, metric string, score double")
    return scores, aggregate_scores(scores)


def temporal_backtest(
    df: DataFrame,
    label: str,
    date: str,
    key: Sequence[str],
    cutoff: str | None = None,
    n_splits: int = 1,
    drop: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fit per temporal fold without the date column; same two tables as cross-validation."""
    kept = drop_columns(df, drop, [date, label, *key])
    rows = []
    for f, (train, test) in enumerate(fold_pairs(kept, date, key, cutoff, n_splits), 1):
        run, _ = fit(train.drop(date), label, key, **options)
        rows += _score_rows(f, run.evaluate(test.drop(date).where(col(label).isNotNull())))
    scores = df.sparkSession.createDataFrame(rows, "fold int, metric string, score double")
    return scores, aggregate_scores(scores)


def search_space(family: str, kind: str, n_trials: int, seed: int = K.SEED) -> list[tuple[object, dict]]:
    """Up to ``n_trials`` (estimator, parameters) pairs of one family: a hash sample of its grid."""
    if family not in FAMILIES:
        raise ValueError(f"model_family '{family}' not supported. Choose from: {sorted(FAMILIES)}")
    f = {"featuresCol": "_features", "labelCol": "_label", "seed": seed}
    reg = kind in ("regression", "quantile")
    if FAMILIES[family] == "boost":
        est = GBTRegressor(**f) if reg else GBTClassifier(**f)
        grid = (
            ParamGridBuilder()
            .addGrid(est.maxDepth, [3, 5, 7])
            .addGrid(est.maxIter, [20, 50])
            .addGrid(est.stepSize, [0.1, 0.05, 0.2])
            .addGrid(est.subsamplingRate, [1.0, 0.8])
            .build()
        )
    else:
        est = RandomForestRegressor(**f) if reg else RandomForestClassifier(**f)
        grid = (
            ParamGridBuilder()
            .addGrid(est.maxDepth, [5, 8, 10])
            .addGrid(est.numTrees, [20, 50, 100])
            .addGrid(est.featureSubsetStrategy, ["auto", "onethird"])
            .addGrid(est.minInstancesPerNode, [1, 5])
            .build()
        )
    def place(params: dict) -> str:
        named = sorted((p.name, str(v)) for p, v in params.items())
        return hashlib.md5(f"{named}|{seed}".encode()).hexdigest()

    trials = []
    for params in sorted(grid, key=place)[:n_trials]:
        one = est.copy(params)
        if FAMILIES[family] == "boost" and kind == "multiclass":
            one = OneVsRest(classifier=one, featuresCol="_features", labelCol="_label")
        trials.append((one, {p.name: v for p, v in params.items()}))
    return trials


def tune_family(
    train: DataFrame,
    label: str,
    key: Sequence[str],
    family: str,
    n_trials: int = 20,
    time_limit: float | None = None,
    eval_metric: str | None = None,
    seed: int = K.SEED,
    parallelism: int = 4,
) -> tuple[Fitted, DataFrame]:
    """One row per trial (``trial, params, score_val, fit_time``), best first, and the best model.

    With ``time_limit`` no new trial starts after so many seconds; the result then depends on the machine. Forests of
    classes are grown together, other trials run side by side, up to ``parallelism`` of them: see :func:`fit`. The best
    model is that of the earliest of equally good trials.
    """
    if family not in FAMILIES:
        raise ValueError(f"model_family '{family}' not supported. Choose from: {sorted(FAMILIES)}")
    kind = problem_type(train.where(col(label).isNotNull()), label)
    trials = search_space(family, kind, n_trials, seed)
    named = {f"{family}_{i + 1}": est for i, (est, _) in enumerate(trials)}
    # the table is split and prepared once for all trials
    run, board = fit(
        train, label, key, eval_metric=eval_metric, estimators=named, blend=False, seed=seed, time_limit=time_limit,
        parallelism=parallelism, only_best=True,
    )
    held = {f"{family}_{i + 1}": {k: str(v) for k, v in params.items()} for i, (_, params) in enumerate(trials)}
    scores = {r["model"]: r for r in board.collect()}
    rows = [(n, p, scores[n]["score_val"], scores[n]["fit_time"]) for n, p in held.items() if n in scores]
    table = train.sparkSession.createDataFrame(
        rows, "trial string, params map<string,string>, score_val double, fit_time double"
    )
    return run, table.orderBy(F.desc("score_val"), "trial")


def scoring_summary(run: Fitted, data: DataFrame) -> DataFrame:
    """One row about a scored table, with scores when the truth is present."""
    truth = run.label in data.columns
    scores = run.evaluate(data.where(col(run.label).isNotNull())) if truth else {}
    score_map = (
        F.create_map(*[F.lit(x) for kv in sorted(scores.items()) for x in kv])
        if scores
        else F.lit(None).cast("map<string,double>")
    )
    return data.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(run.kind).alias("problem_type"),
        F.lit(run.label).alias("label"),
        "num_rows",
        F.lit(len(data.columns)).alias("num_features"),
        F.lit(run.best).alias("best_model"),
        F.lit(truth).alias("has_ground_truth"),
        score_map.alias("eval_scores"),
    )


def improve_until(
    make_data: Callable[[Sequence[str]], tuple[DataFrame, DataFrame]],
    label: str,
    key: Sequence[str],
    metric: str,
    target: float,
    max_iterations: int = 3,
    higher_is_better: bool = True,
    configurations: Sequence[Mapping[str, object]] = ({"quick": True}, {"quick": False}, {"quick": False, "blend": False}),
    record: Callable[[dict, dict], object] | None = None,
    first_drops: Sequence[str] = (),
) -> dict[str, object]:
    """Train, stop at the target, else drop low-importance features and take the next configuration.

    ``make_data(drops)`` gives train and test; ``record(params, metrics)`` is called once per
    iteration. The metric is looked up by name.
    """
    drops, history, best = list(first_drops), [], None
    for i in range(max_iterations):
        options = dict(configurations[i % len(configurations)])
        train, test = make_data(drops)
        result = train_and_evaluate(train, test, label, key, **options)
        scores = result["test_scores"]
        if metric not in scores:
            raise ValueError(f"'{metric}' is not among the scores: {sorted(scores)}")
        value = scores[metric]
        params = {"iteration": i + 1, "drops": ",".join(drops), **{k: str(v) for k, v in options.items()}}
        history.append({"iteration": i + 1, "drops": list(drops), "score": value})
        if record is not None:
            record(params, scores)
        better = best is None or (value > best["score"] if higher_is_better else value < best["score"])
        if better:
            best = {"iteration": i + 1, "score": value, "result": result}
        if value >= target if higher_is_better else value <= target:
            return {"reached": True, "best": best, "history": history}
        low = [r["feature"] for r in low_importance(result["importance"]).collect()]
        fresh = [f for f in low if f not in drops]
        if len(fresh) < len(result["run"].features):
            drops += fresh
    return {"reached": False, "best": best, "history": history}
