"""Shapley values in closed form for tree ensembles and linear models, against a background of any size.

A coalition takes its features from the explained row and the others from a background row. A leaf is reached in it exactly
when each feature on its path satisfies the path in the row it comes from. So of a leaf only two bit patterns matter:
which of its features satisfy the path in the explained row, and which in the background row. The background is therefore
one aggregate (leaf, pattern, rows), whatever its size and however many features there are. With ``u`` features that only
the explained row satisfies and ``v`` that only the background row does, each of the ``u`` gets ``(u-1)! v! / (u+v)!`` of the
leaf's value and each of the ``v`` loses ``u! (v-1)! / (u+v)!`` of it. Linear models need only the mean of the background.

A feature is a column as it was given: the slots of one category, or of one date, are one feature. Near-unique text
columns share hashed slots and are reported as one feature, their names joined by ``+``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.schema import col, require_columns
from tablewright.plans.lineage import cut, scratch_path

#: Aggregated background patterns that go to the tasks at once; trees beyond that take another pass.
MOST_PATTERNS = 1_000_000


@dataclass
class Leaf:
    """A leaf with the features on its path and, per feature, the tests (slot, allowed side) it must pass."""

    number: int
    value: float
    players: list[int] = field(default_factory=list)
    tests: list[list[tuple[int, bool]]] = field(default_factory=list)


@dataclass
class Tree:
    """Inner nodes as columns: slot and either a threshold (left if <=) or the slot values that go left."""

    slots: list[int]
    thresholds: list[float]
    left_values: list[tuple[float, ...] | None]
    leaves: list[Leaf]

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.slots)), bool)
        for i, (slot, t, values) in enumerate(zip(self.slots, self.thresholds, self.left_values, strict=True)):
            out[:, i] = x[:, slot] <= t if values is None else np.isin(x[:, slot], values)
        return out

    def patterns(self, x: np.ndarray) -> Iterator[tuple[Leaf, np.ndarray]]:
        """Per leaf, the bits of its features that satisfy its path in each row."""
        left = self.goes_left(x)
        for leaf in self.leaves:
            bits = np.zeros(len(x), np.int64)
            for k, tests in enumerate(leaf.tests):
                fits = np.ones(len(x), bool)
                for node, side in tests:
                    fits &= left[:, node] == side
                bits |= fits.astype(np.int64) << k
            yield leaf, bits


def slot_features(run, df: DataFrame) -> tuple[list[str], list[int]]:
    """Names of the features of a run and the feature of each slot of its feature vector."""
    assembler = next(s for s in run.prepare.stages if isinstance(s, VectorAssembler))
    parts = assembler.getInputCols()
    row = run.prepare.transform(df.limit(1)).select(*[col(p) for p in parts]).first()
    if row is None:
        raise ValueError("no rows to explain")
    derived = sorted(run.features, key=len, reverse=True)
    names: list[str] = []
    slots: list[int] = []
    for part, value in zip(parts, row, strict=True):
        if part == "_hashed":
            hashed = next(s for s in run.prepare.stages if type(s).__name__ == "FeatureHasher")
            name = "+".join(hashed.getInputCols())
        else:
            inner = part[3:]  # _i_ or _o_
            name = inner if inner in run.features else next(f for f in derived if inner == f"_n_{f}" or inner.startswith(f"_n_{f}_"))
        if name not in names:
            names.append(name)
        slots += [names.index(name)] * (getattr(value, "size", 1) if hasattr(value, "toArray") else 1)
    return names, slots


def exported_trees(spark, model, slots: Sequence[int], at_class: int | None) -> list[Tree]:
    """Trees of an MLlib model with weighted leaf values: mean, class share or margin. The model's size bounds them."""
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in nodes.columns
    rows = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData")).collect() if single else nodes.select("treeID", "nodeData").collect()
    weights = [1.0] if single else list(model.treeWeights)
    total = sum(weights) if type(model).__name__.startswith("RandomForest") else 1.0
    by_tree: dict[int, dict[int, object]] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    trees, number = [], 0
    for t in sorted(by_tree):
        held = by_tree[t]
        tree = Tree([], [], [], [])
        todo: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while todo:
            at, path_tests = todo.pop()
            node = held[at]
            if node["leftChild"] >= 0:
                split = node["split"]
                here = len(tree.slots)
                tree.slots.append(split["featureIndex"])
                values = split["leftCategoriesOrThreshold"]
                number_split = split["numCategories"] < 0
                tree.thresholds.append(values[0] if number_split else 0.0)
                tree.left_values.append(None if number_split else tuple(values))
                todo += [(node["rightChild"], [*path_tests, (here, False)]), (node["leftChild"], [*path_tests, (here, True)])]
                continue
            value = node["prediction"]
            if at_class is not None and not type(model).__name__.startswith("GBT"):
                stats = node["impurityStats"]
                value = stats[at_class] / sum(stats) if sum(stats) else 0.0
            leaf = Leaf(number, value * weights[t] / total)
            number += 1
            by_player: dict[int, list[tuple[int, bool]]] = {}
            for test in path_tests:
                by_player.setdefault(slots[tree.slots[test[0]]], []).append(test)
            leaf.players, leaf.tests = list(by_player), list(by_player.values())
            tree.leaves.append(leaf)
        trees.append(tree)
    return trees


def background_patterns(prepared: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    """(leaf, pattern, n) of a table with the array ``_x``; counted in the tasks before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["_x"].to_numpy())
            leaf, pattern, n = [], [], []
            for tree in trees:
                for place, bits in tree.patterns(x):
                    found, rows = np.unique(bits, return_counts=True)
                    leaf.append(np.full(len(found), place.number))
                    pattern.append(found)
                    n.append(rows)
            yield pd.DataFrame({"leaf": np.concatenate(leaf), "pattern": np.concatenate(pattern), "n": np.concatenate(n)})

    counted = prepared.select("_x").mapInPandas(count, "leaf bigint, pattern bigint, n bigint")
    return counted.groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))


def shares(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a feature of the ``u`` gains and one of the ``v`` loses, per unit of a leaf's value."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(invalid="ignore"):
        gain = np.exp(lg(np.maximum(u, 1)) + lg(v + 1.0) - lg(u + v + 1.0))
        loss = np.exp(lg(u + 1.0) + lg(np.maximum(v, 1)) - lg(u + v + 1.0))
    return np.where(u > 0, gain, 0.0), np.where(v > 0, loss, 0.0)


def leaf_values(own: np.ndarray, behind: np.ndarray, weight: np.ndarray, features: int) -> np.ndarray:
    """(own pattern, feature) sums over the background patterns of one leaf of value 1."""
    full = (1 << features) - 1
    a, b = own[:, None], behind[None]
    reached = ((a | b) == full) * weight
    gain, loss = shares(np.bitwise_count(a & ~b & full).astype(np.int64), np.bitwise_count(~a & b & full).astype(np.int64))
    out = np.empty((len(own), features))
    for k in range(features):
        mine, theirs = (a >> k) & 1, (b >> k) & 1
        out[:, k] = (reached * (gain * (mine & ~theirs & 1) - loss * (theirs & ~mine & 1))).sum(1)
    return out


def tree_values(trees: Sequence[Tree], held: dict[int, tuple[np.ndarray, np.ndarray]], n_features: int):
    """Function of feature arrays: values of all features, then the prediction and the base value."""

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch.to_numpy())
            out = np.zeros((len(x), n_features + 2))
            for tree in trees:
                for leaf, bits in tree.patterns(x):
                    behind, weight = held[leaf.number]
                    full = (1 << len(leaf.players)) - 1
                    out[:, -2] += leaf.value * (bits == full)
                    out[:, -1] += leaf.value * weight[behind == full].sum()
                    if leaf.players:
                        own, back = np.unique(bits, return_inverse=True)
                        out[:, leaf.players] += leaf.value * leaf_values(own, behind, weight, len(leaf.players))[back]
            yield pd.Series(list(out))

    return values


def _grouped(trees: Sequence[Tree], sizes: dict[int, int], most: int) -> Iterator[list[Tree]]:
    part, held = [], 0
    for tree in trees:
        size = sum(sizes.get(leaf.number, 0) for leaf in tree.leaves)
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(tree)
        held += size
    if part:
        yield part


def model_shapley(
    df: DataFrame, run, key: Sequence[str], background: DataFrame | None = None, model: str | None = None,
    of_class: object = None, most_patterns: int = MOST_PATTERNS,
) -> DataFrame:
    """Long ``(key..., prediction, base_value, method, feature, shap_value, feature_value)`` of every row.

    Exact for every feature count and for the whole ``background`` (``df`` by default). Forests and single trees of classes are
    explained as probabilities of ``of_class`` (the highest by default), boosted classes and logistic models as margins.
    """
    require_columns(df, [*run.features, *key], "model_shapley")
    source = df if background is None else background
    fitted = run.models[model or run.best]
    kind = type(fitted).__name__
    names, slots = slot_features(run, df)
    at_class = None
    if run.classes:
        at_class = len(run.classes) - 1 if of_class is None else run.classes.index(of_class)

    def arrays(table: DataFrame, *kept: str) -> DataFrame:
        own = [col(f) for f in run.features if f not in kept]
        ready = run.prepare.transform(table.select(*[col(k) for k in kept], *own))
        return ready.select(*[col(k) for k in kept], *own, vector_to_array("_features").alias("_x"))

    rows = arrays(df, *key)
    if kind.startswith(("LinearRegression", "LogisticRegression")):
        if run.classes and len(run.classes) > 2:
            weights, start = fitted.coefficientMatrix.toArray()[at_class].tolist(), float(fitted.interceptVector[at_class])
        else:
            sign = -1.0 if run.classes and at_class == 0 else 1.0
            weights, start = [sign * w for w in fitted.coefficients.toArray().tolist()], sign * float(fitted.intercept)
        mean = arrays(source).agg(*[F.avg(F.get("_x", F.lit(i))) for i in range(len(slots))]).first()
        parts = [[] for _ in names]
        for i, feature in enumerate(slots):
            if weights[i]:
                parts[feature].append((F.get("_x", F.lit(i)) - F.lit(mean[i])) * F.lit(weights[i]))
        base = start + sum(w * m for w, m in zip(weights, mean, strict=True))
        made = [sum(p, F.lit(0.0)) for p in parts]
        scored = rows.withColumn("_all", F.array(*made, sum(made, F.lit(base)), F.lit(base)))
        method = "linear"
    elif kind.startswith(("DecisionTree", "RandomForest", "GBT")):
        trees = exported_trees(df.sparkSession, fitted, slots, at_class)
        if kind.startswith("GBT") and at_class == 0:
            for tree in trees:
                for leaf in tree.leaves:
                    leaf.value = -leaf.value
        patterns = cut(background_patterns(arrays(source), trees))
        n = source.count()
        sizes = {r[0]: r[1] for r in patterns.groupBy("leaf").count().collect()}  # one row per leaf of the model
        scored = rows.withColumn("_all", F.array(*[F.lit(0.0)] * (len(names) + 2)))
        for part in _grouped(trees, sizes, most_patterns):
            first, last = part[0].leaves[0].number, part[-1].leaves[-1].number
            table = patterns.where(F.col("leaf").between(first, last)).toPandas().sort_values(["leaf", "pattern"])
            held = {int(k): (g["pattern"].to_numpy(), g["n"].to_numpy() / n) for k, g in table.groupby("leaf")}
            values = tree_values(part, held, len(names))
            scored = scored.withColumn("_part", values("_x")).withColumn("_all", F.zip_with("_all", "_part", lambda a, b: a + b)).drop("_part")
        method = "tree"
    else:
        raise ValueError(f"no closed form for {kind}; use explain.shapley_values")

    def shown(name: str):
        return col(name).cast("string") if name in run.features else F.concat_ws("+", *[col(c).cast("string") for c in name.split("+") if c in run.features])

    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.get("_all", F.lit(i)).alias("shap_value"), shown(f).alias("feature_value")) for i, f in enumerate(names)
    ])
    return scored.select(
        *[col(k) for k in key], F.get("_all", F.lit(len(names))).alias("prediction"), F.get("_all", F.lit(len(names) + 1)).alias("base_value"),
        F.lit(method).alias("method"), F.inline(cells),
    )
