"""Deterministic splits: stratified, k-fold, cutoff and walk-forward.

Every split is a per-row comparison with a few literals found by counting passes over the
key and label (or date) columns, so the table itself is neither shuffled nor sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright import constants as K
from tablewright.functions.hashing import hash_order, hash_prefix
from tablewright.functions.schema import col, drop_columns, numeric_columns
from tablewright.functions.stats import to_micros
from tablewright.plans import strata
from tablewright.plans.cuts import CELL_ROWS, hash_cuts, segment_by_cuts
from tablewright.plans.lineage import cut
from tablewright.plans.selection import exact_quantiles, order_statistics
from tablewright.plans.totals import weighted_edges, with_bucket

MAX_STRATA = 100


def _strata(df: DataFrame, label: str) -> list[tuple] | DataFrame:
    """Sorted ``(class, rows)``, or the table ``g, n`` of more classes than a plan should name."""
    counted = cut(df.groupBy(col(label).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    if not counted.where("g IS NULL").isEmpty():
        raise ValueError(f"'{label}' holds NULL; drop those rows before a stratified split")
    rows = counted.limit(MAX_STRATA + 1).collect()
    return counted if len(rows) > MAX_STRATA else sorted((r["g"], r["n"]) for r in rows)


def _sizes(counts: list[tuple] | DataFrame) -> tuple[int, int, int, int]:
    """Classes, rows, rows of the smallest and of the largest class."""
    if isinstance(counts, DataFrame):
        return tuple(counts.agg(F.count(F.lit(1)), F.sum("n"), F.min("n"), F.max("n")).first())
    sizes = [n for _, n in counts]
    return len(sizes), sum(sizes), min(sizes, default=0), max(sizes, default=0)


def _keyed(df: DataFrame, label: str | None, key: Sequence[str], seed: int) -> DataFrame:
    group = col(label) if label else F.lit(0)
    return df.select(group.alias("g"), hash_order(key, seed).alias("h"))


def share_out(counts: Sequence[int], total: int) -> list[int]:
    """Split ``total`` in proportion to ``counts``; leftovers go to the largest remainders."""
    whole = sum(counts)
    exact = [total * c / whole for c in counts]
    out = [math.floor(e) for e in exact]
    order = sorted(range(len(counts)), key=lambda i: (-(exact[i] - out[i]), i))
    for i in order[: total - sum(out)]:
        out[i] += 1
    return out


def assign_test(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    test_size: float = K.TEST_FRACTION,
    seed: int = K.SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add boolean ``is_test``: exactly ``ceil(test_size * rows)`` rows, per class when stratified.

    Any number of classes: up to ``MAX_STRATA`` their cuts are literals of the plan, beyond that a joined table.
    """
    counts = _strata(df, label) if label else [(0, df.count())]
    classes, rows, smallest, largest = _sizes(counts)
    n_test = math.ceil(test_size * rows)
    if label:
        if classes and smallest < 2:
            raise ValueError("a class has only one row; it cannot be in both train and test")
        if n_test < classes or rows - n_test < classes:
            raise ValueError("too few rows for every class to be in both train and test")
    if isinstance(counts, DataFrame):
        edges = strata.cut_table(_keyed(df, label, key, seed), strata.shared_out(counts, rows, n_test), rows, cell_rows)
        marked = strata.with_segment(df, col(label), hash_order(key, seed), edges, rows, "is_test")
        return marked.withColumn("is_test", F.col("is_test") == 0)
    per_class = share_out([n for _, n in counts], n_test)
    targets = {g: [t] for (g, _), t in zip(counts, per_class, strict=True)}
    cuts = hash_cuts(_keyed(df, label, key, seed), targets, largest, cell_rows)
    group = col(label) if label else F.lit(0)
    return df.withColumn("is_test", segment_by_cuts(group, hash_order(key, seed), cuts) == 0)


def train_test_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    drop: Sequence[str] = (),
    test_size: float = K.TEST_FRACTION,
    seed: int = K.SEED,
    stratify: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Drop unwanted columns, then split (by class when ``stratify``)."""
    kept = drop_columns(df, drop)
    marked = assign_test(kept, key, label if stratify else None, test_size, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def fold_plan(counts: Sequence[int], k: int) -> list[list[int]]:
    """Rows of each class in each fold: classes are dealt round-robin one after another.

    Both the folds and every class within them differ by at most one row.
    """
    plan, start = [], 0
    for n in counts:
        plan.append([len(range((f - start) % k, n, k)) for f in range(k)])
        start += n
    return plan


def assign_folds(
    df: DataFrame,
    key: Sequence[str],
    k: int,
    label: str | None = None,
    seed: int = K.SEED,
    cell_rows: int = CELL_ROWS,
    column: str = "fold",
) -> DataFrame:
    """Add fold number ``0..k-1``; each fold is a range of the hash order of its class."""
    counts = _strata(df, label) if label else [(0, df.count())]
    _, rows, _, largest = _sizes(counts)
    if label and largest < k:
        raise ValueError(f"no class has {k} rows")
    if rows < k:
        raise ValueError(f"fewer than {k} rows")
    if isinstance(counts, DataFrame):
        edges = strata.cut_table(_keyed(df, label, key, seed), strata.dealt_out(counts, k), rows, cell_rows)
        return strata.with_segment(df, col(label), hash_order(key, seed), edges, rows, column)
    targets = {}
    for (g, _), sizes in zip(counts, fold_plan([n for _, n in counts], k), strict=True):
        ends, at = [], 0
        for n in sizes[:-1]:
            at += n
            ends.append(at)
        targets[g] = ends
    cuts = hash_cuts(_keyed(df, label, key, seed), targets, largest, cell_rows)
    group = col(label) if label else F.lit(0)
    return df.withColumn(column, segment_by_cuts(group, hash_order(key, seed), cuts).cast("int"))


def robust_scale(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str] | None = None, label: str | None = None) -> list[DataFrame]:
    """``(x - median) / IQR`` with both fitted on ``train`` only; returns scaled train, then the others."""
    columns = list(columns) if columns is not None else numeric_columns(train, [label] if label else [])
    q = exact_quantiles(train, columns, [0.25, 0.5, 0.75])
    new: dict[str, Column] = {}
    for c in columns:
        q1, mid, q3 = q[c]
        if mid is None:
            continue
        new[c] = (col(c).cast("double") - F.lit(mid)) / F.lit((q3 - q1) or 1.0)
    return [df.withColumns(new) if new else df for df in (train, *others)]


def cutoff_split(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Train strictly before the cutoff, test from it on; either side empty is an error."""
    t = col(date)
    at = F.lit(cutoff).cast(df.schema[date].dataType)
    early, late, first, last = df.agg(
        F.count_if(t < at), F.count_if(t >= at), F.min(t).cast("string"), F.max(t).cast("string")
    ).first()
    if not early or not late:
        raise ValueError(f"nothing on one side of {cutoff}: '{date}' runs from {first} to {last}")
    return df.where(t < at), df.where(t >= at)


def walk_forward_cuts(
    df: DataFrame, date: str, key: Sequence[str], k: int, seed: int = K.SEED, cell_rows: int = CELL_ROWS
) -> list[tuple[int, str]]:
    """``(date in microseconds, digest)`` of the last row of each of the first ``k`` chunks.

    Rows are ordered by date, equal dates by hash, so a date holding most of the rows can
    be cut inside. First the date at each boundary is selected, then the digest within it.
    """
    slim = df.select(to_micros(col(date)).alias("t"), hash_order(key, seed).alias("h")).where("t IS NOT NULL")
    rows = slim.count()
    chunk = rows // (k + 1)
    if chunk < 1:
        raise ValueError(f"{rows} dated rows cannot make {k + 1} chunks")
    ranks = [chunk * i - 1 for i in range(1, k + 1)]
    dates = order_statistics(slim.select("t"), {"t": ranks}, {"t": rows})["t"]
    targets: dict[int, list[int]] = {}
    for r in ranks:
        value, below = dates[r]
        targets.setdefault(value, []).append(r + 1 - below)
    cuts = hash_cuts(slim.select(F.col("t").alias("g"), "h"), targets, rows, cell_rows)
    return [(t, h) for t in targets for h in cuts[t]]


def _chunk_number(date: str, key: Sequence[str], cuts: Sequence[tuple[int, str]], seed: int) -> Column:
    t, h = to_micros(col(date)), hash_order(key, seed)
    after = [((t > F.lit(d)) | ((t == F.lit(d)) & (h > F.lit(x)))).cast("int") for d, x in cuts]
    return sum(after, F.lit(0))


def walk_forward(
    df: DataFrame, date: str, key: Sequence[str], k: int, seed: int = K.SEED, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per (input row, fold it takes part in), with ``fold`` 1..k and ``role``.

    Chunk ``c`` is the test part of fold ``c`` and a training part of every later fold.
    """
    cuts = walk_forward_cuts(df, date, key, k, seed, cell_rows)
    chunked = df.where(col(date).isNotNull()).withColumn("_chunk", _chunk_number(date, key, cuts, seed))
    return (
        chunked.withColumn("fold", F.explode(F.sequence(F.greatest("_chunk", F.lit(1)), F.lit(k))))
        .withColumn("role", F.when(F.col("_chunk") == F.col("fold"), "test").otherwise("train"))
        .drop("_chunk")
    )


def temporal_folds(
    df: DataFrame, date: str, key: Sequence[str], cutoff: str | None = None, n_splits: int = 1
) -> DataFrame:
    """Cutoff split as a single fold, or walk-forward folds: ``fold, role`` added."""
    if n_splits == 1 and cutoff:
        train, test = cutoff_split(df, date, cutoff)
        both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
        return both.withColumn("fold", F.lit(1))
    return walk_forward(df, date, key, n_splits)


def fold_pairs(
    df: DataFrame, date: str, key: Sequence[str], cutoff: str | None = None, n_splits: int = 1, seed: int = K.SEED
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) per fold. Rows carry their chunk and are filtered by it, so no row is copied per fold."""
    if n_splits == 1 and cutoff:
        yield cutoff_split(df, date, cutoff)
        return
    cuts = walk_forward_cuts(df, date, key, n_splits, seed)
    chunked = df.where(col(date).isNotNull()).withColumn("_chunk", _chunk_number(date, key, cuts, seed))
    for f in range(1, n_splits + 1):
        yield chunked.where(F.col("_chunk") < f).drop("_chunk"), chunked.where(F.col("_chunk") == f).drop("_chunk")


def fold_ranges(folds: DataFrame, date: str) -> DataFrame:
    """Rows and first and last date per fold and role."""
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(col(date)).alias("first_date"),
        F.max(col(date)).alias("last_date"),
    )


def aggregate_scores(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation per metric from ``fold, metric, score`` rows."""
    return folds.groupBy("metric").agg(
        F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.stddev_pop("score"), 6).alias("std"),
        F.count("score").alias("folds"),
    )


def aggregate_score_maps(folds: DataFrame, column: str = "scores") -> DataFrame:
    """Same for one ``map<metric, score>`` per fold."""
    return aggregate_scores(folds.select(F.explode(column).alias("metric", "score")))


def global_row_number(
    df: DataFrame, order: str, key: Sequence[str], seed: int = K.SEED, column: str = "row_number"
) -> DataFrame:
    """1-based position after sorting by ``order`` (a number or date), ties in hash order.

    Cells are value ranges; a value that fills several ranges on its own is cut into as many
    digest ranges, so there are at most three cells per bucket. Cell offsets come from a
    window over cell counts.
    """
    number = col(order).cast("double") if order in numeric_columns(df) else to_micros(col(order)).cast("double")
    keyed = df.withColumns({"_v": number, "_h": hash_order(key, seed)})
    known = keyed.where("_v IS NOT NULL")
    weights = weighted_edges(known, "_v")
    on_edge = F.col("_v").isin(list(weights)) if weights else F.lit(False)
    heavy = {e: n for e, n in weights.items() if n > 1}
    parts = F.lit(1)
    if heavy:
        pairs = [F.lit(x) for e, n in heavy.items() for x in (e, n)]
        parts = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_v")), F.lit(1))
    cells = with_bucket(known, "_v", list(weights), "_b").withColumns(
        {
            "_above": (~on_edge).cast("int"),
            "_sub": F.floor(hash_prefix(F.col("_h")) * parts / F.lit(65536)).cast("int"),
        }
    )
    cell = ["_b", "_above", "_sub"]
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*cell)
        .count()
        .withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*cell).orderBy("_v", "_h")
    return (
        cells.join(F.broadcast(offsets), cell)
        .withColumn(column, F.col("_off") + F.row_number().over(inside))
        .drop(*cell, "_off", "_v", "_h")
    )
