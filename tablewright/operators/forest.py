"""Random forests of one search, grown together over counted cells.

MLlib bins the features first and then reads every row once per level and forest. Rows with the same bins and the same
class go the same way in every tree, so here they are counted once (a cell), and all forests of a search are grown level
by level from the cells, with one job per level. A row's bootstrap weight is Poisson(1), so the weight of a cell of ``n``
rows is Poisson(n): the same law as drawing for each row.

Rules are those of MLlib's classifier: at most ``maxBins`` bins, Gini gain, features drawn per node, children of at least
``minInstancesPerNode`` drawn rows, siblings of one prediction merged. Draws depend on the seed, the tree and the node
alone, as they do between MLlib forests of one seed: a forest of fewer trees is the beginning of a larger one, a flatter
one its top. So each of them is grown once, and any of them comes out the same when grown by itself.

Nothing is assumed of the rows: where no two are alike there are as many cells as rows, in tasks of bounded size.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans.attach import MOST_ROWS_PER_PASS_TASK, ROWS_PER_PASS_TASK, SMALL_TASKS
from tablewright.plans.lineage import cut, scratch_path

#: Slots of the feature vector whose edges are found in one job.
SLOTS_A_JOB = 64
#: Slots of at most about so many values are cut between all of them.
FEW_VALUES = 64
QUANTILE_ACCURACY = 10_000
#: Rows that a task bins before it counts them, and bytes of bins that it holds at most, then and as a task of cells.
ROWS_PER_TALLY = 500_000
BIN_BYTES_PER_TASK = 64 << 20
#: Bytes of the counts of all nodes in one job, and of one node.
LEVEL_BYTES = 256 << 20
NODE_BYTES = 64 << 10
#: Parameters that may be set; any other keeps its default or the forest is left to MLlib.
KNOWN_PARAMS = {"featuresCol", "labelCol", "seed", "maxDepth", "numTrees", "featureSubsetStrategy", "minInstancesPerNode"}
SUBSETS = ("auto", "sqrt", "onethird", "all", "log2")


def can_share(estimators: Mapping[str, object], n_classes: int) -> bool:
    """Whether all are MLlib's forest classifier with one seed and only parameters that are followed here."""
    found = list(estimators.values())
    if n_classes < 2 or not found or any(type(e) is not RandomForestClassifier for e in found):
        return False
    return len({e.getSeed() for e in found}) == 1 and all(
        {p.name for p in e._paramMap} <= KNOWN_PARAMS and e.getFeatureSubsetStrategy() in SUBSETS and e.getMaxDepth() > 0
        and (e.getFeaturesCol(), e.getLabelCol()) == ("_features", "_label")
        for e in found
    )


def features_per_node(strategy: str, slots: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    return {
        "all": slots, "sqrt": math.ceil(math.sqrt(slots)), "onethird": math.ceil(slots / 3.0),
        "log2": max(1, math.ceil(math.log2(slots))),
    }[strategy]


# ---- cells

def _slot(i: int) -> Column:
    return F.get("_x", F.lit(i))


def bin_edges(rows: DataFrame, slots: int, most_bins: int) -> list[np.ndarray]:
    """Per slot the ascending thresholds; a value is right of a threshold when it is larger.

    Slots of up to ``most_bins`` values are cut halfway between all of them, others at the quantiles of all rows.
    """
    rows = rows.select(vector_to_array("_features").alias("_x"))
    edges: list[np.ndarray] = []
    for first in range(0, slots, SLOTS_A_JOB):
        block = range(first, min(first + SLOTS_A_JOB, slots))
        known = {i: F.nanvl(_slot(i), F.lit(None)) for i in block}
        sizes = rows.agg(*[F.approx_count_distinct(known[i]) for i in block]).first()
        shares = F.array(*[F.lit(k / most_bins) for k in range(1, most_bins)])
        many = F.array().cast("array<double>")
        found = rows.agg(*[
            F.struct(
                F.collect_set(known[i]) if n <= FEW_VALUES else many,
                F.percentile_approx(known[i], shares, QUANTILE_ACCURACY) if n > most_bins // 4 else many,
                F.max(known[i]),
            )
            for i, n in zip(block, sizes, strict=True)
        ]).first()
        for values, ranked, largest in found:
            values = np.unique(np.asarray(values, float))
            if 0 < len(values) <= most_bins:
                found_edges = (values[:-1] + values[1:]) / 2
            else:
                ranked = np.unique(np.asarray(ranked or values[:: len(values) // most_bins + 1], float))
                found_edges = ranked[ranked < largest] if largest is not None else ranked
            edges.append(found_edges[np.isfinite(found_edges)])
    return edges


def _bytes_column(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The binary values of a column, each of ``width`` items, as rows of a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return held.view(dtype).reshape(len(column), width)


def _distinct(bins: np.ndarray, more: np.ndarray, radix: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(index of a first row, rows)`` of the distinct rows of ``bins`` with ``more``."""
    if math.prod(radix) < 2**62:
        code = more.astype(np.int64)
        for i, r in enumerate(radix[1:]):
            code = code * r + bins[:, i]
    else:
        whole = np.ascontiguousarray(np.hstack([bins, more.astype(np.uint32)[:, None].view(np.uint8)]))
        code = whole.view(np.dtype((np.void, whole.shape[1]))).ravel()
    _, at, n = np.unique(code, return_index=True, return_counts=True)
    return at, n


def count_cells(ready: DataFrame, edges: Sequence[np.ndarray], n_classes: int) -> DataFrame:
    """``key`` (a byte per slot), ``y``, ``is_test``, ``n`` and ``part``, one row per distinct cell, laid out by themselves.

    ``part`` numbers the tasks; rows of a task are in order, so that draws per task do not depend on files or cores.
    """
    slots = len(edges)
    radix = [2 * n_classes, *[len(e) + 1 for e in edges]]

    most = max(1, min(ROWS_PER_TALLY, BIN_BYTES_PER_TASK // max(slots, 1)))

    def binned(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, slots)
        bins = np.empty(x.shape, np.uint8)
        for i, e in enumerate(edges):
            bins[:, i] = np.searchsorted(e, x[:, i])
        return bins, b["y"].to_numpy() * 2 + b["is_test"].to_numpy(zero_copy_only=False)

    def tally(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bins, more = (np.concatenate(x) for x in zip(*held, strict=True))
        at, n = _distinct(bins, more, radix)
        made = [_bytes_column(bins[at]), pa.array(more[at] // 2, pa.int32()), pa.array(more[at] % 2 == 1), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(made, ["key", "y", "is_test", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(binned(b))
                rows += b.num_rows
            if rows >= most:
                yield tally(held)
                held, rows = [], 0
        if rows:
            yield tally(held)

    slim = ready.select("is_test", F.col("_label").cast("int").alias("y"), vector_to_array("_features").alias("x"))
    made = slim.mapInArrow(run, "key binary, y int, is_test boolean, n bigint")
    cells = cut(made.groupBy("key", "y", "is_test").agg(F.sum("n").alias("n")))
    rows = cells.count()
    tasks = min(math.ceil(rows / ROWS_PER_PASS_TASK), max(SMALL_TASKS, math.ceil(rows / MOST_ROWS_PER_PASS_TASK)))
    tasks = max(1, tasks, math.ceil(rows * slots / BIN_BYTES_PER_TASK))
    order = ["key", "y", "is_test"]
    return cut(cells.repartition(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _held(batches: Iterator[pa.RecordBatch], slots: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """Part, bins, classes and rows of the cells of one task."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    bins = np.vstack([_matrix(b["key"], np.uint8, slots) for b in parts])
    y = np.concatenate([b["y"].to_numpy() for b in parts]).astype(np.int64)
    n = np.concatenate([b["n"].to_numpy() for b in parts])
    return parts[0]["part"][0].as_py(), bins, y, n


# ---- trees

@dataclass
class Grown:
    """Trees of the forests with ``m`` features per node; one set of them for each of ``leasts``, the minimal rows of a node.

    Flat over all trees: the split of a node (bins above ``cut`` go right; a leaf points to itself), its children ``left``
    and ``left + 1``, the drawn rows per class, and the numbers of its set, tree, level and place in the tree.
    """

    m: int
    leasts: list[int]
    trees: int
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray
    level: np.ndarray
    place: np.ndarray

    def ends(self, depth: int) -> np.ndarray:
        """Nodes at which the trees of ``depth`` levels end: siblings of one prediction are merged, from below."""
        inner = self.left != np.arange(len(self.left))
        end = ~inner | (self.level >= depth)
        said = self.counts.argmax(axis=1)
        for level in range(depth - 1, -1, -1):
            at = np.flatnonzero(inner & (self.level == level))
            a, b = self.left[at], self.left[at] + 1
            end[at[end[a] & end[b] & (said[a] == said[b])]] = True
        return end


def _walk(bins: np.ndarray, root: int, feature: np.ndarray, cuts: np.ndarray, left: np.ndarray, steps: int) -> np.ndarray:
    at = np.full(len(bins), root, np.int64)
    rows = np.arange(len(bins))
    for _ in range(steps):
        at = left[at] + (bins[rows, feature[at]] > cuts[at])
    return at


def _hashed(*parts: object) -> np.ndarray:
    """64 bits that depend on all parts, which broadcast against each other."""
    h = np.array([0x9E3779B97F4A7C15], np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def _drawn_features(seed: int, tree: np.ndarray, place: np.ndarray, slots: int, m: int) -> np.ndarray:
    """``m`` slots for each node, in order."""
    out = np.empty((len(tree), m), np.int64)
    step = max(1, (16 << 20) // (8 * slots))
    for i in range(0, len(tree), step):
        h = _hashed(seed, tree[i : i + step, None], place[i : i + step, None], np.arange(slots)[None, :])
        out[i : i + step] = np.sort(np.argsort(h, axis=1, kind="stable")[:, :m], axis=1)
    return out


def best_splits(counts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which feature, last bin on the left, gain and left counts of the best split of ``nodes x features x bins x classes``.

    The gain is -1 where no split leaves ``least`` rows on both sides.
    """
    left = counts.cumsum(axis=2)[:, :, :-1]
    total = counts[:, :1].sum(axis=2, keepdims=True)
    right = total - left

    def gini(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = c.sum(axis=-1)
        return n, 1.0 - ((c / np.maximum(n, 1)[..., None]) ** 2).sum(axis=-1)

    n, whole = gini(total)
    (a, low), (b, high) = gini(left), gini(right)
    gain = whole - a / np.maximum(n, 1) * low - b / np.maximum(n, 1) * high
    bound = least[:, None, None]
    gain = np.where((a >= bound) & (b >= bound), gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    which, bins = np.divmod(best, left.shape[2])
    rows = np.arange(len(counts))
    return which, bins, gain[rows, best], left[rows, which, bins]


def grow(
    cells: DataFrame, slots: int, n_bins: int, n_classes: int, m: int, leasts: Sequence[int], trees: int, depth: int, seed: int
) -> Grown:
    """Grow ``trees`` trees of ``depth`` levels for each of ``leasts`` over the cells that are not of the test slice."""
    # a class can't be told apart in a table without two bins
    n_bins = max(n_bins, 2)
    sets = len(leasts)
    nodes = sets * trees
    # a tree is drawn the same in all sets; trees of one number stand together
    out = Grown(
        m, list(leasts), trees, np.arange(nodes).reshape(trees, sets), np.zeros(nodes, np.int64), np.full(nodes, n_bins, np.int64),
        np.arange(nodes), np.zeros((nodes, n_classes), np.int64), np.zeros(nodes, np.int64), np.ones(nodes, np.int64),
    )
    tree_of, set_of = np.divmod(np.arange(nodes), sets)
    fit_cells = cells.where("NOT is_test").select("part", "key", "y", "n")
    width = m * n_bins * n_classes
    active = np.arange(nodes)
    for level in range(depth):
        # children that can be split further, in the order of their trees
        found = []
        most = max(1, LEVEL_BYTES // (width * 8))
        for i in range(0, len(active), most):
            group = active[i : i + most]
            drawn = _drawn_features(seed, tree_of[group], out.place[group], slots, m)
            task = _Tally(slots, n_bins, n_classes, seed, level, out.feature, out.cut, out.left, out.roots, group, tree_of[group], set_of[group], drawn)
            least = np.asarray(leasts)[set_of[group]]
            made = fit_cells.mapInArrow(task, "node bigint, counts binary")
            tasks = max(1, min(SMALL_TASKS, math.ceil(len(group) / 1_000)))
            chosen = made.repartition(tasks, "node").mapInArrow(_Choose(m, n_bins, n_classes, least), "node bigint, which int, bin int, gain double, here binary, lower binary")
            got = chosen.toArrow().combine_chunks()
            if not got.num_rows:
                continue
            cols = {c: got[c].to_numpy() for c in ("node", "which", "bin", "gain")}
            here, lower = (_matrix(got[c].chunk(0), np.int64, n_classes) for c in ("here", "lower"))
            at = cols["node"]
            found.append((group[at], drawn[at, cols["which"]], cols["bin"], cols["gain"], here, lower))
        if not found:
            break
        node, feature, bins, gain, here, lower = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node)
        node, feature, bins, gain, here, lower = (x[order] for x in (node, feature, bins, gain, here, lower))
        out.counts[node] = here
        node, feature, bins, here, lower = (x[gain > 0] for x in (node, feature, bins, here, lower))
        start, k = len(out.left), len(node)
        out.feature[node], out.cut[node], out.left[node] = feature, bins, start + 2 * np.arange(k)
        kids = np.stack([lower, here - lower], axis=1).reshape(2 * k, n_classes)
        place = np.stack([2 * out.place[node], 2 * out.place[node] + 1], axis=1).ravel()
        out.feature = np.concatenate([out.feature, np.zeros(2 * k, np.int64)])
        out.cut = np.concatenate([out.cut, np.full(2 * k, n_bins, np.int64)])
        out.left = np.concatenate([out.left, start + np.arange(2 * k)])
        out.counts = np.concatenate([out.counts, kids])
        out.level = np.concatenate([out.level, np.full(2 * k, level + 1, np.int64)])
        out.place = np.concatenate([out.place, place])
        tree_of, set_of = (np.concatenate([x, np.repeat(x[node], 2)]) for x in (tree_of, set_of))
        mixed = kids.max(axis=1) < kids.sum(axis=1)
        active = start + np.flatnonzero(mixed)
        active = active[np.argsort(tree_of[active] * sets + set_of[active], kind="stable")]
        if not len(active):
            break
    return out


class _Tally:
    """Counts per node, drawn feature, bin and class over the cells of one task; a row per node of the job."""

    def __init__(self, slots, n_bins, n_classes, seed, level, feature, cuts, left, roots, group, tree, of_set, drawn):
        self.slots, self.n_bins, self.n_classes, self.seed, self.level = slots, n_bins, n_classes, seed, level
        self.feature, self.cuts, self.left, self.roots, self.drawn = feature, cuts, left, roots, drawn
        self.slot = np.full(len(left), -1, np.int64)
        self.slot[group] = np.arange(len(group))
        # nodes of one tree and set stand together
        pair = tree * roots.shape[1] + of_set
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        self.runs = list(zip(tree[first].tolist(), of_set[first].tolist(), first.tolist(), [*first[1:].tolist(), len(group)], strict=True))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _held(batches, self.slots)
        if cells is None:
            return
        part, bins, y, n = cells
        m, last = self.drawn.shape[1], None
        for tree, of_set, lo, hi in self.runs:
            if tree != last:
                weight = draw_bag(self.seed, tree, part, n)
                kept = np.flatnonzero(weight)
                b, c, w = bins[kept], y[kept], weight[kept].astype(float)
                last = tree
            at = self.slot[_walk(b, self.roots[tree, of_set], self.feature, self.cuts, self.left, self.level)]
            inside = np.flatnonzero((at >= lo) & (at < hi))
            if not len(inside):
                continue
            bi, ci, wi, at = b[inside], c[inside], w[inside], at[inside]
            rows = np.arange(len(inside))
            counts = np.empty((hi - lo, m, self.n_bins * self.n_classes), np.int64)
            for j in range(m):
                code = ((at - lo) * self.n_bins + bi[rows, self.drawn[at, j]]) * self.n_classes + ci
                counts[:, j] = np.bincount(code, wi, (hi - lo) * self.n_bins * self.n_classes).reshape(hi - lo, -1)
            some = np.flatnonzero(counts[:, 0].any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some + lo, pa.int64()), _bytes_column(counts[some].reshape(len(some), -1))], ["node", "counts"])


def draw_bag(seed: int, tree: int, part: int, n: np.ndarray) -> np.ndarray:
    """How often the rows of each cell are drawn for a tree: the sum of ``n`` Poisson(1) numbers."""
    key = _hashed(seed, tree, part)[0]
    return np.random.Generator(np.random.Philox(key=int(key))).poisson(n)


class _Choose:
    """Sums the counts of each node and takes its best split."""

    def __init__(self, m, n_bins, n_classes, least):
        self.shape, self.least = (m, n_bins, n_classes), least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = math.prod(self.shape)
        nodes, sums = np.empty(0, np.int64), np.empty((0, width), np.int64)
        for b in batches:
            if b.num_rows:
                both = np.concatenate([nodes, b["node"].to_numpy()])
                held = np.concatenate([sums, _matrix(b["counts"], np.int64, width)])
                order = np.argsort(both, kind="stable")
                nodes, first = np.unique(both[order], return_index=True)
                sums = np.add.reduceat(held[order], first, axis=0)
        step = max(1, (16 << 20) // (8 * width))
        for i in range(0, len(nodes), step):
            counts = sums[i : i + step].reshape(-1, *self.shape)
            which, bins, gain, lower = best_splits(counts, self.least[nodes[i : i + step]])
            made = [
                pa.array(nodes[i : i + step]), pa.array(which, pa.int32()), pa.array(bins, pa.int32()), pa.array(gain),
                _bytes_column(counts[:, 0].sum(axis=1)), _bytes_column(lower),
            ]
            yield pa.RecordBatch.from_arrays(made, ["node", "which", "bin", "gain", "here", "lower"])


# ---- forests

@dataclass
class Trial:
    """A forest of a search: the trees it takes of what is grown."""

    m: int
    least: int
    trees: int
    depth: int


class Search:
    """Forests over one prepared table: ``is_test, _label, _features``, the classes numbered from 0."""

    def __init__(self, ready: DataFrame, n_classes: int, most_bins: int = 32):
        fitting = ready.where("NOT is_test")
        self.slots = fitting.select(F.size(vector_to_array("_features"))).first()[0]
        self.n_classes = n_classes
        self.edges = bin_edges(fitting, self.slots, most_bins)
        self.n_bins = max(2, *[len(e) + 1 for e in self.edges])
        self.ready = ready
        self.grown: dict[int, Grown] = {}
        self.trials: dict[str, Trial] = {}
        self.ends: dict[tuple[int, int], np.ndarray] = {}

    @cached_property
    def cells(self) -> DataFrame:
        return count_cells(self.ready, self.edges, self.n_classes)

    def grow(self, estimators: Mapping[str, RandomForestClassifier]) -> None:
        """Grow all of ``estimators``; what was grown before is replaced."""
        self.grown, self.ends = {}, {}
        self.trials = {
            name: Trial(features_per_node(e.getFeatureSubsetStrategy(), self.slots, e.getNumTrees()), e.getMinInstancesPerNode(), e.getNumTrees(), e.getMaxDepth())
            for name, e in estimators.items()
        }
        seed = next(iter(estimators.values())).getSeed()
        for m in sorted({t.m for t in self.trials.values()}):
            alike = [t for t in self.trials.values() if t.m == m]
            self.grown[m] = grow(
                self.cells, self.slots, self.n_bins, self.n_classes, m, sorted({t.least for t in alike}),
                max(t.trees for t in alike), max(t.depth for t in alike), seed,
            )
        self.ends = {(t.m, t.depth): self.grown[t.m].ends(t.depth) for t in self.trials.values()}

    def node_bytes(self, estimators: Mapping[str, RandomForestClassifier]) -> int:
        """Bytes of the counts of one node of the largest forest."""
        most = max(features_per_node(e.getFeatureSubsetStrategy(), self.slots, e.getNumTrees()) for e in estimators.values())
        return most * self.n_bins * self.n_classes * 8

    def scored(self) -> DataFrame:
        """``model``, ``y``, ``value`` (class probabilities) and ``n`` rows: the test slice by every forest."""
        run = _Score(self.slots, self.n_classes, self.grown, self.trials, self.ends)
        cells = self.cells.where("is_test").select("part", "key", "y", "n")
        return cells.mapInArrow(run, "model string, y int, value array<double>, n bigint")

    def model(self, spark: SparkSession, name: str, est: RandomForestClassifier) -> RandomForestClassificationModel:
        """The forest as MLlib's model, through MLlib's own file format."""
        trial = self.trials[name]
        g, end = self.grown[trial.m], self.ends[trial.m, trial.depth]
        at_set = g.leasts.index(trial.least)
        nodes = []
        for tree in range(trial.trees):
            todo, numbers = [int(g.roots[tree, at_set])], 1
            # by level, so that children come after their parent
            for number, at in enumerate(todo):
                counts = g.counts[at].astype(float)
                shares = counts / (counts.sum() or 1.0)
                impurity = float(1.0 - (shares**2).sum()) if counts.sum() else 0.0
                split, kids, gain = (-1, [], -1), (-1, -1), -1.0
                if not end[at]:
                    low = int(g.left[at])
                    kids, numbers = (numbers, numbers + 1), numbers + 2
                    todo += [low, low + 1]
                    split = (int(g.feature[at]), [float(self.edges[g.feature[at]][g.cut[at]])], -1)
                    gain = impurity - sum(self._weighted(g.counts[k]) for k in (low, low + 1)) / float(counts.sum())
                nodes.append((tree, (number, float(counts.argmax()), impurity, counts.tolist(), int(counts.sum()), gain, *kids, split)))
        return _loaded(spark, est, nodes, trial.trees, self.slots, self.n_classes)

    @staticmethod
    def _weighted(counts: np.ndarray) -> float:
        n = float(counts.sum())
        return n - float((counts.astype(float) ** 2).sum()) / n if n else 0.0


class _Score:
    """Class probabilities of every cell by every forest: trees add their shares in order, as MLlib's model does."""

    def __init__(self, slots, n_classes, grown, trials, ends):
        self.slots, self.n_classes, self.jobs = slots, n_classes, []
        for m, depth in sorted({(t.m, t.depth) for t in trials.values()}):
            g, end = grown[m], ends[m, depth]
            own = np.arange(len(end))
            walk = (np.where(end, 0, g.feature), np.where(end, np.iinfo(np.int64).max, g.cut), np.where(end, own, g.left))
            shares = g.counts / np.maximum(g.counts.sum(axis=1), 1)[:, None]
            for i, least in enumerate(g.leasts):
                wanted: dict[int, list[str]] = {}
                for name, t in trials.items():
                    if (t.m, t.depth, t.least) == (m, depth, least):
                        wanted.setdefault(t.trees, []).append(name)
                if wanted:
                    self.jobs.append((g.roots[:, i], walk, shares, depth, wanted))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _held(batches, self.slots)
        if cells is None:
            return
        _, bins, y, n = cells
        for roots, walk, shares, depth, wanted in self.jobs:
            votes = np.zeros((len(n), self.n_classes))
            for tree in range(max(wanted)):
                votes += shares[_walk(bins, roots[tree], *walk, depth)]
                for name in wanted.get(tree + 1, ()):
                    total = votes.sum(axis=1, keepdims=True)
                    value = np.divide(votes, total, out=np.zeros_like(votes), where=total > 0)
                    lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * self.n_classes, value.ravel())
                    made = [pa.array([name] * len(n)), pa.array(y, pa.int32()), lists, pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, ["model", "y", "value", "n"])


NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)
FOREST_ONLY = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")


def _loaded(
    spark: SparkSession, est: RandomForestClassifier, nodes: list[tuple], trees: int, slots: int, n_classes: int
) -> RandomForestClassificationModel:
    path = scratch_path(spark, "forest")
    name = "org.apache.spark.ml.classification.%s"
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}

    def params(held: Mapping, of_tree: bool) -> dict:
        return {p.name: v for p, v in held.items() if not (of_tree and p.name in FOREST_ONLY)}

    def about(kind: str, uid: str, of_tree: bool, **more: int) -> str:
        maps = {"paramMap": params(est._paramMap, of_tree), "defaultParamMap": params(est._defaultParamMap, of_tree)}
        return json.dumps({"class": name % kind, **common, "uid": uid, **maps, **more})

    top = about("RandomForestClassificationModel", est.uid, False, numFeatures=slots, numClasses=n_classes, numTrees=trees)
    each = [(t, about("DecisionTreeClassificationModel", f"{est.uid}_{t}", True), 1.0) for t in range(trees)]
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODE).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
