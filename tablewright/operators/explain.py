"""Model-agnostic explanation: permutation importance, Shapley values, partial dependence.

Every operator builds tagged copies of the rows, scores them in one pass and aggregates by
tag. ``predict`` is any function that adds a numeric ``prediction`` column, such as an
MLlib ``transform`` wrapped by :func:`tablewright.operators.train.Fitted.predict`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.hashing import hash_order, hash_prefix
from tablewright.functions.schema import categorical_columns, col, numeric_columns, require_columns
from tablewright.functions.stats import pair_corr
from tablewright.operators import evaluate
from tablewright.operators.sampling import hash_sample
from tablewright.plans.attach import spread_for_copies
from tablewright.plans.lineage import cut

Predict = Callable[[DataFrame], DataFrame]

BUCKET_ROWS = 100_000
EXACT_FEATURES = 10


def _replace(df: DataFrame, features: Sequence[str], new: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({f: new(f) for f in features})


def shuffle_within_buckets(
    df: DataFrame, features: Sequence[str], key: Sequence[str], seed: int, rows: int
) -> DataFrame:
    """Add struct ``_donor``: the features of the next row in a random cyclic order.

    The order is the hash order, cut into ranges of about ``BUCKET_ROWS`` rows, each of
    which is a cycle of its own: one shuffle serves every feature.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    digest = hash_order(key, seed)
    keyed = df.withColumns(
        {"_h": digest, "_b": F.floor(hash_prefix(digest, 7) * F.lit(float(buckets)) / F.lit(16.0**7)).cast("int")}
    )
    cycle = Window.partitionBy("_b").orderBy("_h", *key)
    whole = cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*[col(f).alias(f) for f in features])
    donor = F.when(F.row_number().over(cycle) == 1, F.last(own).over(whole)).otherwise(F.lag(own).over(cycle))
    return keyed.withColumn("_donor", donor).drop("_h", "_b")


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    predict: Predict,
    score: Column | Callable[[DataFrame], DataFrame],
    repeats: int = 1,
    seed: int = K.SEED,
) -> DataFrame:
    """``feature, importance, stddev``: drop of ``score`` (higher is better) when shuffled.

    ``score`` is an aggregate over the scored table. One that is no aggregate of rows is a function from the scored
    copies, which carry ``_tag``, to ``_tag, score``.
    """
    require_columns(df, [*features, *key], "permutation_importance")
    rows = df.count()
    frames = []
    for r in range(repeats):
        donors = shuffle_within_buckets(df, features, key, seed + r, rows)
        tags = F.array(F.lit("_base"), *[F.lit(f) for f in features])
        copies = donors.withColumn("_tag", F.explode(tags))
        shuffled = _replace(
            copies, features, lambda f: F.when(F.col("_tag") == f, F.col(f"_donor.`{f}`")).otherwise(col(f))
        )
        scored = predict(shuffled.drop("_donor"))
        tagged = scored.groupBy("_tag").agg(score.alias("score")) if isinstance(score, Column) else score(scored)
        frames.append(tagged.select("_tag", "score").withColumn("_r", F.lit(r)))
    scores = frames[0]
    for f in frames[1:]:
        scores = scores.unionByName(f)
    base = F.max(F.when(F.col("_tag") == "_base", F.col("score"))).over(Window.partitionBy("_r"))
    drops = scores.withColumn("drop", base - F.col("score")).where("_tag <> '_base'")
    return drops.groupBy(F.col("_tag").alias("feature")).agg(
        F.avg("drop").alias("importance"),
        F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("stddev"),
    )


def auc_score(
    rows: DataFrame, predict: Predict, actual: str, pos_label, score: str | Column = "prediction"
) -> Callable[[DataFrame], DataFrame]:
    """ROC AUC as the score of :func:`permutation_importance`: tie-aware ranks inside every tag, all tags at once.

    ``score`` is the positive class's score in the output of ``predict``. Large tables get score buckets from the
    untouched rows.
    """
    value = col(score) if isinstance(score, str) else score

    def slim(scored: DataFrame, *tags: str) -> DataFrame:
        return scored.select(*tags, col(actual).alias("_y"), value.cast("double").alias("_s"))

    edges = evaluate.score_edges(slim(predict(rows)), "_s")
    return lambda scored: evaluate.roc_auc_by(slim(scored, "_tag"), "_y", "_s", pos_label, ["_tag"], edges).withColumnRenamed(
        "roc_auc", "score"
    )


def _background(df: DataFrame, features: Sequence[str], key: Sequence[str], n: int, seed: int) -> list:
    """At most ``n`` rows, collected: they become a literal of the plan."""
    return hash_sample(df, key, n, seed).select(*[col(f) for f in features]).collect()


def _literal_rows(rows: Sequence, df: DataFrame, features: Sequence[str]) -> Column:
    types = dict(df.dtypes)
    return F.array(
        *[F.struct(*[F.lit(r[f]).cast(types[f]).alias(f) for f in features]) for r in rows]
    )


def shapley_values(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    predict: Predict,
    background: DataFrame | None = None,
    background_rows: int = K.SHAP_BACKGROUND,
    max_rows: int | None = None,
    permutations: int = 32,
    seed: int = K.SEED,
) -> DataFrame:
    """Long ``(key..., prediction, base_value, method, feature, shap_value, feature_value)``.

    Up to ``EXACT_FEATURES`` features every coalition is evaluated, which is exact for the
    given background (``method`` is ``exact``); above that, random orderings are averaged (``sampled``). All
    copies of a row are aggregated in the task that made them before anything is shuffled, by hash: its own values
    are part of the key, since an aggregate of a struct or text would sort the copies. For one class of
    several, pass a ``predict`` that gives its probability.
    """
    require_columns(df, [*features, *key], "shapley_values")
    source = df if background is None else background
    rows = hash_sample(df, key, max_rows, seed) if max_rows is not None else df
    base_rows = _background(source, features, key, background_rows, seed)
    steps = 2 ** len(features) if len(features) <= EXACT_FEATURES else permutations * (len(features) + 1)
    slim = rows.select(*[col(k) for k in key], *[col(f) for f in features if f not in key])
    own = spread_for_copies(slim, key, len(base_rows) * steps).withColumns(
        {"_own": F.struct(*[col(f).alias(f) for f in features]), "_shown": F.array(*[col(f).cast("string") for f in features])}
    )
    with_base = own.withColumn("_bg", F.explode(_literal_rows(base_rows, df, features)))
    exact = len(features) <= EXACT_FEATURES
    if exact:
        copies, weights = _coalitions(with_base, features)
        full, none = F.col("_in") == 2 ** len(features) - 1, F.col("_in") == 0
    else:
        copies, weights = _orderings(with_base, features, permutations, seed)
        full, none = F.col("_step") == len(features), F.col("_step") == 0
    scored = predict(copies)
    per_row = scored.groupBy(*[col(k) for k in key], "_shown").agg(
        F.avg(F.when(full, F.col("prediction"))).alias("prediction"),
        F.avg(F.when(none, F.col("prediction"))).alias("base_value"),
        *[
            (F.sum(F.col("prediction") * w) / F.lit(float(len(base_rows)))).alias(f"_s{i}")
            for i, w in enumerate(weights)
        ],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"_s{i}").alias("shap_value"),
                F.get("_shown", F.lit(i)).alias("feature_value"),
            )
            for i, f in enumerate(features)
        ]
    )
    return per_row.select(*[col(k) for k in key], "prediction", "base_value", F.lit("exact" if exact else "sampled").alias("method"), F.inline(cells))


def _use(copies: DataFrame, features: Sequence[str], has: Callable[[int], Column]) -> DataFrame:
    """Feature ``i`` comes from the explained row where ``has(i)``, else from the background row."""
    place = {f: i for i, f in enumerate(features)}
    return _replace(
        copies, features, lambda f: F.when(has(place[f]), F.col(f"_own.`{f}`")).otherwise(F.col(f"_bg.`{f}`"))
    )


def _coalitions(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    n = len(features)
    copies = df.withColumn("_in", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    size = F.bit_count("_in")
    # weight of adding a feature to a coalition that already holds s others
    table = F.array(*[F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) for s in range(n)])

    def has(i: int) -> Column:
        return F.col("_in").bitwiseAND(F.lit(1 << i)) > 0

    weights = [F.when(has(i), F.get(table, size - 1)).otherwise(-F.get(table, size)) for i in range(n)]
    return _use(copies, features, has), weights


def _orderings(
    df: DataFrame, features: Sequence[str], permutations: int, seed: int
) -> tuple[DataFrame, list[Column]]:
    """Orderings of the features by digest. In step ``k`` of one a row has the ``k`` features that come first."""
    n = len(features)

    def places(p: int) -> list[int]:
        order = sorted(range(n), key=lambda i: hashlib.md5(f"{features[i]}|{p}|{seed}".encode()).hexdigest())
        return [order.index(i) for i in range(n)]

    orders = F.array(*[F.array(*[F.lit(x) for x in places(p)]) for p in range(permutations)])
    copies = df.withColumn("_places", F.explode(orders)).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(n))))

    def place(i: int) -> Column:
        return F.get("_places", F.lit(i))

    weights = [
        F.when(place(i) == F.col("_step") - 1, 1.0).when(place(i) == F.col("_step"), -1.0).otherwise(0.0) / F.lit(float(permutations))
        for i in range(n)
    ]
    return _use(copies, features, lambda i: place(i) < F.col("_step")), weights


def shap_summary(shap: DataFrame, *more: Column) -> DataFrame:
    """``feature, mean_abs_shap, rank`` (mean over classes first when there is a ``class``).

    ``more`` are further aggregates per feature, made in the same pass.
    """
    means = shap.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"), *more)
    order = Window.orderBy(F.desc("mean_abs_shap"), "feature")  # one row per feature
    return means.withColumn("rank", F.row_number().over(order))


def shap_top_features(
    shap: DataFrame, key: Sequence[str], top: int = K.SHAP_TOP_PER_ROW
) -> DataFrame:
    """Per row the ``top`` features by absolute value, as an array of structs.

    A row contributes one entry per feature, so the collected list has a fixed size.
    """
    if "class" in shap.columns:
        shap = shap.groupBy(*key, "feature").agg(
            F.avg("shap_value").alias("shap_value"), F.first("feature_value").alias("feature_value")
        )
    entry = F.struct(
        (-F.abs("shap_value")).alias("k"),
        "feature",
        F.round("shap_value", 6).alias("shap_value"),
        "feature_value",
    )
    ranked = shap.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, top).alias("t"))
    return ranked.select(
        *key,
        F.transform(
            "t",
            lambda x: F.struct(
                x["feature"].alias("feature"),
                x["shap_value"].alias("shap_value"),
                x["feature_value"].alias("feature_value"),
            ),
        ).alias("top_features"),
    )


def shap_wide(shap: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One column per feature (class mean), for writing out."""
    return shap.groupBy(*key).agg(
        *[F.avg(F.when(F.col("feature") == f, F.col("shap_value"))).alias(f) for f in features]
    )


def shap_interactions(shap: DataFrame, key: Sequence[str], top_k: int = 5) -> DataFrame:
    """Correlation of value columns over the top features: ``feature_a, feature_b, corr, abs_corr, hint``.

    Ranks and correlations read the values twice; they are kept in between, so that the copies behind them are scored once.
    """
    held = shap.select(*[col(k) for k in key], "feature", "shap_value").persist()
    try:
        summary = shap_summary(held).where(F.col("rank") <= top_k).orderBy("rank").collect()
        names = [r["feature"] for r in summary]
        schema = "feature_a string, feature_b string, corr double, abs_corr double, hint string"
        if len(names) < 2:
            return shap.sparkSession.createDataFrame([], schema)
        wide = shap_wide(held.where(F.col("feature").isin(names)), key, names)
        cells = F.array(
            *[
                F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), pair_corr(col(a), col(b)).alias("r"))
                for a, b in combinations(names, 2)
            ]
        )
        pairs = cut(wide.agg(cells.alias("c")).select(F.inline("c")).where("r IS NOT NULL"))
    finally:
        held.unpersist()
    strong = F.abs("corr") > K.SHAP_PAIR_CORR
    return (
        pairs.select("feature_a", "feature_b", F.round("r", 4).alias("corr"))
        .withColumn("abs_corr", F.abs("corr"))
        .withColumn(
            "hint",
            F.when(strong & (F.col("corr") > 0), "redundant: drop one, or use their ratio or product").when(
                strong, "opposed: try their difference or ratio"
            ),
        )
        .orderBy(F.desc("abs_corr"), "feature_a", "feature_b")
    )


def pdp_grid(df: DataFrame, features: Sequence[str], n_values: int = K.PDP_GRID) -> dict[str, list]:
    """Equally spaced values between min and max, or the most frequent categories."""
    numeric = [f for f in features if f in numeric_columns(df)]
    text = [f for f in features if f in categorical_columns(df)]
    grid: dict[str, list] = {}
    if numeric:
        row = df.agg(
            *[F.min(col(f).cast("double")) for f in numeric], *[F.max(col(f).cast("double")) for f in numeric]
        ).first()
        for i, f in enumerate(numeric):
            lo, hi = row[i], row[len(numeric) + i]
            if lo is None:
                grid[f] = []
                continue
            step = (hi - lo) / max(1, n_values - 1)
            grid[f] = [lo + step * k for k in range(n_values - 1)] + [hi]
    for f in text:
        top = df.where(col(f).isNotNull()).groupBy(col(f).alias("v")).count()
        grid[f] = [r["v"] for r in top.orderBy(F.desc("count"), "v").limit(n_values).collect()]
    return grid


def partial_dependence(
    df: DataFrame,
    predict: Predict,
    features: Sequence[str],
    key: Sequence[str],
    n_values: int = K.PDP_GRID,
    sample_size: int | None = None,
    seed: int = K.SEED,
) -> DataFrame:
    """``feature, position, is_numeric, grid, pdp``: mean prediction with the feature set to each value.

    Every row counts unless ``sample_size`` asks for fewer. A feature without a value has no curve. All curves come from one scoring pass, and
    copies are averaged before they are shuffled.
    """
    require_columns(df, [*features, *key], "partial_dependence")
    grid = pdp_grid(df, features, n_values)
    rows = hash_sample(df, key, sample_size, seed) if sample_size is not None else df
    numeric = set(numeric_columns(df))
    points = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(i).alias("position"),
            F.lit(float(v) if f in numeric else None).cast("double").alias("number"),
            F.lit(None if f in numeric else str(v)).cast("string").alias("word"),
        )
        for f in features
        for i, v in enumerate(grid[f])
    ]
    copies = spread_for_copies(rows, key, len(points)).withColumn("_point", F.explode(F.array(*points)))
    types = dict(df.dtypes)
    # a numeric column takes fractional grid values, so it is scored as a double
    shifted = _replace(
        copies,
        features,
        lambda f: F.when(
            F.col("_point.feature") == f,
            F.col("_point.number") if f in numeric else F.col("_point.word").cast(types[f]),
        ).otherwise(col(f).cast("double") if f in numeric else col(f)),
    )
    return (
        predict(shifted)
        .groupBy("_point")
        .agg(F.round(F.avg("prediction"), 6).alias("pdp"))
        .select(
            "_point.feature",
            "_point.position",
            F.col("_point.number").isNotNull().alias("is_numeric"),
            F.coalesce(F.col("_point.number").cast("string"), F.col("_point.word")).alias("grid"),
            "pdp",
        )
    )


def pdp_shapes(curves: DataFrame) -> DataFrame:
    """``feature, shape, span`` for numeric curves of three points or more.

    A flat curve counts as increasing. Non-monotone curves are named only when they span
    more than 0.05. A curve has at most as many points as its grid.
    """
    step = F.col("pdp") - F.lag("pdp").over(Window.partitionBy("feature").orderBy("position"))
    return (
        curves.where("is_numeric")
        .withColumn("d", step)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(False)).alias("up"),
            F.coalesce(F.bool_and(F.col("d") <= 0), F.lit(False)).alias("down"),
            F.round(F.max("pdp") - F.min("pdp"), 6).alias("span"),
        )
        .where("points >= 3")
        .select(
            "feature",
            F.when(F.col("up"), "increasing")
            .when(F.col("down"), "decreasing")
            .when(F.col("span") > K.PDP_SPAN, "non-monotonic")
            .alias("shape"),
            "span",
        )
    )
