"""Exact order statistics and quantiles without sorting or collecting a column.

Spark's ``percentile`` keeps every distinct value of a column in one task, which a
continuous column over a large table cannot afford. Here a mergeable sketch proposes a
narrow bracket around each wanted rank, one counting pass proves which side of the
bracket the rank is on, and the loop repeats inside the bracket until at most
``exact_rows`` values are left; only those are collected. Nothing is shuffled but one
small row per task. All columns and ranks share each pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.schema import col, nan_to_null
from tablewright.plans.binning import binned_long

EXACT_ROWS = 4_000
COLUMNS_PER_PASS = 50
BUILTIN_ROWS = 50_000
MIN_ACCURACY, MAX_ACCURACY = 1_000, 10_000


@dataclass
class _Hunt:
    """One wanted rank; the value lies strictly between ``lo`` and ``hi``."""

    name: str
    rank: int
    size: int
    below: int = 0
    lo: float | int | None = None
    hi: float | int | None = None
    value: float | int | None = None
    done: bool = False

    @property
    def bracket(self) -> tuple:
        return (self.name, self.lo, self.hi)


def _inside(x: Column, lo, hi) -> Column:
    if lo is None and hi is None:
        return x
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (x > F.lit(lo))
    if hi is not None:
        cond = cond & (x < F.lit(hi))
    return F.when(cond, x)


def order_statistics(
    df: DataFrame,
    wanted: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int],
    exact_rows: int = EXACT_ROWS,
) -> dict[str, dict[int, tuple]]:
    """``{column: {rank: (value, rows strictly below value)}}`` for zero-based ranks.

    ``sizes`` holds the non-null count of each column. Columns must be numeric.
    """
    hunts = [
        _Hunt(name, r, sizes[name]) for name, ranks in wanted.items() for r in sorted(set(ranks))
    ]
    for h in hunts:
        if not 0 <= h.rank < h.size:
            raise ValueError(f"rank {h.rank} outside 0..{h.size - 1} for column '{h.name}'")
    while True:
        open_hunts = [h for h in hunts if not h.done]
        big = [h for h in open_hunts if h.size > exact_rows]
        if not big:
            _finish(df, open_hunts)
            break
        # just sharp enough for the next bracket to be collected, within what a sketch can hold
        largest = max(h.size for h in big)
        _narrow(df, big, min(MAX_ACCURACY, max(MIN_ACCURACY, 8 * largest // exact_rows)))
    out: dict[str, dict[int, tuple]] = {name: {} for name in wanted}
    for h in hunts:
        out[h.name][h.rank] = (h.value, h.below)
    return out


def _finish(df: DataFrame, hunts: list[_Hunt]) -> None:
    if not hunts:
        return
    brackets = list(dict.fromkeys(h.bracket for h in hunts))
    row = df.agg(
        *[
            F.sort_array(F.collect_list(_inside(col(name), lo, hi))).alias(f"b{i}")
            for i, (name, lo, hi) in enumerate(brackets)
        ]
    ).first()
    values = {b: row[i] for i, b in enumerate(brackets)}
    for h in hunts:
        vs = values[h.bracket]
        h.value = vs[h.rank - h.below]
        h.below += vs.index(h.value)
        h.done = True


def _narrow(df: DataFrame, hunts: list[_Hunt], accuracy: int) -> None:
    groups: dict[tuple, list[_Hunt]] = {}
    for h in hunts:
        groups.setdefault(h.bracket, []).append(h)
    margin = 2.0 / accuracy
    sketches = []
    for i, ((name, lo, hi), members) in enumerate(groups.items()):
        points = []
        for h in members:
            p = (h.rank - h.below + 0.5) / h.size
            points += [max(0.0, p - margin), min(1.0, p + margin)]
        sketches.append(
            F.percentile_approx(_inside(col(name), lo, hi), points, accuracy).alias(f"s{i}")
        )
    row = df.agg(*sketches).first()
    edges = []
    for i, members in enumerate(groups.values()):
        for j, h in enumerate(members):
            edges.append((h, row[i][2 * j], row[i][2 * j + 1]))
    marks = list(dict.fromkeys((h.name, e) for h, a, b in edges for e in (a, b)))
    below = _rank_of_marks(df, marks)
    lt = {m: below[m][0] for m in marks}
    le = {m: below[m][1] for m in marks}
    for h, a, b in edges:
        end = h.below + h.size
        for edge in (a, b):
            first, last = lt[(h.name, edge)], le[(h.name, edge)]
            if first <= h.rank < last:
                h.value, h.below, h.done = edge, first, True
                break
            if h.rank < first:
                h.hi, end = edge, min(end, first)
                break
            h.lo, h.below = edge, last
        if not h.done:
            h.size = end - h.below


def _rank_of_marks(df: DataFrame, marks: list[tuple]) -> dict[tuple, tuple[int, int]]:
    """``{(column, value): (rows below, rows at or below)}`` from one binned count."""
    edges: dict[str, set[float]] = {}
    for name, v in marks:
        # the next double splits "equal" from "above"
        edges.setdefault(name, set()).update((float(v), math.nextafter(float(v), math.inf)))
    ordered = {name: sorted(vs) for name, vs in edges.items()}
    long = binned_long(df, {name: col(name) for name in ordered}, ordered)
    rows = long.groupBy("feature", "bin").count().collect()
    counts = {name: [0] * (len(vs) + 1) for name, vs in ordered.items()}
    for r in rows:
        counts[r["feature"]][r["bin"]] = r["count"]
    out = {}
    for name, v in marks:
        at = ordered[name].index(float(v))
        out[(name, v)] = (sum(counts[name][: at + 1]), sum(counts[name][: at + 2]))
    return out


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    builtin_rows: int = BUILTIN_ROWS,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column (NULL and NaN ignored), computed exactly."""
    if not columns:
        return {}
    if len(columns) > COLUMNS_PER_PASS:
        # bounds what one aggregation row, and the driver, has to hold
        head, rest = columns[:COLUMNS_PER_PASS], columns[COLUMNS_PER_PASS:]
        return exact_quantiles(df, head, probs, builtin_rows, exact_rows) | exact_quantiles(
            df, rest, probs, builtin_rows, exact_rows
        )
    frame = nan_to_null(df.select(*[col(c).cast("double").alias(c) for c in columns]))
    sizes = frame.agg(*[F.count(col(c)).alias(c) for c in columns]).first().asDict()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    present = [c for c in columns if sizes[c]]
    if not present:
        return out
    if max(sizes.values()) <= builtin_rows:
        # few enough rows for the built-in aggregate, whose buffer holds distinct values
        row = frame.agg(
            *[F.percentile(col(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in present]
        ).first()
        return out | {c: list(row[c]) for c in present}
    wanted: dict[str, list[int]] = {}
    for c in present:
        spots = [p * (sizes[c] - 1) for p in probs]
        wanted[c] = [r for x in spots for r in (math.floor(x), math.ceil(x))]
    found = order_statistics(frame, wanted, sizes, exact_rows)
    for c in present:
        values = []
        for p in probs:
            spot = p * (sizes[c] - 1)
            lo, hi = found[c][math.floor(spot)][0], found[c][math.ceil(spot)][0]
            values.append(lo + (hi - lo) * (spot - math.floor(spot)))
        out[c] = values
    return out
