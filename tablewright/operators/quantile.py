"""Quantile regression: estimators that minimise the pinball loss, next to MLlib's.

Both work on ``features`` vectors and a double label and are used like MLlib estimators: ``fit`` gives a model whose
``transform`` adds ``prediction``. What a step gathers is one row per leaf or one coefficient vector, whatever the
number of rows. Each model ends with a shift by the exact quantile of its residuals, so that the wanted share of the
fitted rows lies at or below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.schema import col
from tablewright.plans.lineage import cut
from tablewright.plans.selection import exact_quantiles

ROUNDS_PER_CUT = 5
LEAF_ACCURACY = 10_000


def check_level(level: float) -> float:
    if not 0 < level < 1:
        raise ValueError(f"a quantile level lies between 0 and 1, not {level}")
    return level


def pinball(actual: Column, predicted: Column, level: float) -> Column:
    """Loss of one row: ``level`` times what is missing, or ``1 - level`` times what is too much."""
    gap = actual - predicted
    return F.greatest(gap * F.lit(level), gap * F.lit(level - 1.0))


def quantile_scores(df: DataFrame, actual: str, predicted: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """``pinball_loss``, ``coverage`` (share of rows at or below the prediction) and ``rows``, per group of ``by``.

    Rows without a truth or a prediction are left out; no row at all gives NULL scores and 0 rows.
    """
    check_level(level)
    y, f = col(actual).cast("double"), col(predicted).cast("double")
    return (
        df.where(y.isNotNull() & f.isNotNull() & ~F.isnan(y) & ~F.isnan(f))
        .groupBy(*[col(c) for c in by])
        .agg(
            F.avg(pinball(y, f, level)).alias("pinball_loss"),
            F.avg((y <= f).cast("double")).alias("coverage"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def _shift(scored: DataFrame, label: str, level: float) -> float:
    gaps = scored.select((col(label) - F.col("prediction")).alias("_gap"))
    return float(exact_quantiles(gaps, ["_gap"], [level])["_gap"][0])


def _added(what: str, also_drop: Sequence[str] = ()) -> SQLTransformer:
    """A stage that adds the SQL number ``what`` to ``prediction``, so that fitted models are plain pipelines."""
    gone = ", ".join(["prediction", *also_drop])
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), prediction + {what} AS prediction FROM __THIS__")


@dataclass
class LinearQuantile:
    """Linear quantile regression by reweighted least squares.

    A step bounds the pinball loss from above by a parabola that touches it at the current residuals r: least squares
    with weight 1 / (|r| + e) on the label moved by (2 level - 1)(|r| + e). It ends when the coefficients no longer
    move, or after ``steps`` passes. e is a thousandth of the mean absolute residual of ordinary least squares.
    """

    level: float
    steps: int = 40
    tolerance: float = 1e-4
    featuresCol: str = "_features"
    labelCol: str = "_label"

    def fit(self, df: DataFrame) -> PipelineModel:
        check_level(self.level)
        gap = col(self.labelCol) - F.col("prediction")
        model = LinearRegression(featuresCol=self.featuresCol, labelCol=self.labelCol).fit(df)
        scale = model.transform(df).agg(F.avg(F.abs(gap))).first()[0] or 0.0
        step = LinearRegression(featuresCol=self.featuresCol, labelCol="_moved", weightCol="_weight")
        size = F.abs(gap) + F.lit(scale * 1e-3)
        for _ in range(self.steps if scale > 0 else 0):
            moved = col(self.labelCol) + F.lit(2 * self.level - 1) * size
            rows = model.transform(df).select(col(self.featuresCol), (1.0 / size).alias("_weight"), moved.alias("_moved"))
            before, model = _numbers(model), step.fit(rows)
            now = _numbers(model)
            # without slopes the shift below does it all
            if not now[:-1].any() or np.abs(now - before).sum() <= self.tolerance * max(np.abs(now).sum(), scale):
                break
        return PipelineModel([model, _added(_literal(_shift(model.transform(df), self.labelCol, self.level)))])


def _numbers(model: LinearRegressionModel) -> np.ndarray:
    return np.r_[model.coefficients.toArray(), model.intercept]


def _literal(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


@dataclass
class BoostedQuantile:
    """Gradient boosting on the pinball loss.

    Each tree is grown on the sign of the residuals; a leaf's value is then the quantile of its residuals (a mergeable
    sketch, one row per leaf). ``rounds=1, rate=1`` is a single quantile tree.
    """

    level: float
    rounds: int = 20
    rate: float = 0.3
    depth: int = 5
    seed: int = K.SEED
    featuresCol: str = "_features"
    labelCol: str = "_label"

    def fit(self, df: DataFrame) -> PipelineModel:
        check_level(self.level)
        start = float(exact_quantiles(df, [self.labelCol], [self.level])[self.labelCol][0])
        now = df.select(col(self.featuresCol), col(self.labelCol), F.lit(start).alias("prediction"))
        grow = DecisionTreeRegressor(featuresCol=self.featuresCol, labelCol="_above", maxDepth=self.depth, seed=self.seed)
        above = F.when(col(self.labelCol) > F.col("prediction"), self.level).otherwise(self.level - 1.0)
        gap = F.percentile_approx(col(self.labelCol) - F.col("prediction"), self.level, LEAF_ACCURACY)
        stages = [SQLTransformer(statement=f"SELECT *, {_literal(start)} AS prediction FROM __THIS__")]
        for i in range(self.rounds):
            tree = grow.fit(now.select(col(self.featuresCol), above.alias("_above")))
            tree.setLeafCol("_leaf").setPredictionCol("")
            found = dict(tree.transform(now).groupBy(F.col("_leaf").cast("int")).agg(gap).collect())
            values = [_literal(self.rate * found.get(k, 0.0)) for k in range((tree.numNodes + 1) // 2)]
            leaf = _added(f"get(array({', '.join(values)}), CAST(_leaf AS INT))", ["_leaf"])
            stages += [tree, leaf]
            now = leaf.transform(tree.transform(now))
            if (i + 1) % ROUNDS_PER_CUT == 0 and i + 1 < self.rounds:
                now = cut(now)
        return PipelineModel([*stages, _added(_literal(_shift(now, self.labelCol, self.level)))])


def candidates(level: float, seed: int = K.SEED, quick: bool = False) -> dict[str, object]:
    """Estimators of a quantile run."""
    rounds, depth = (5, 4) if quick else (20, 5)
    return {
        "Linear": LinearQuantile(level, steps=15 if quick else 40),
        "GradientBoosting": BoostedQuantile(level, rounds=rounds, depth=depth, seed=seed),
        "DecisionTree": BoostedQuantile(level, rounds=1, rate=1.0, depth=depth, seed=seed),
    }
