"""Streaming scoring and windowed drift against a fixed training distribution."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.schema import col
from tablewright.operators.drift import array_total, bin_counts, drift_edges, drift_status, psi, side_stats
from tablewright.operators.errors import flag_low_confidence


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], min_confidence: float | None = None
) -> DataFrame:
    """Stateless: the batch scorer and flag on a stream. Rows may come in any order."""
    return flag_low_confidence(score(stream), min_confidence)


def training_profile(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[list[float], list[int]]]:
    """Edges and training bin counts per feature: a few numbers that the stream carries as literals."""
    edges = drift_edges(train, features)
    counts = {r["feature"]: list(r["counts"]) for r in side_stats(train, edges).collect()}
    return {f: (edges[f], counts[f]) for f in features if edges[f]}


def windowed_counts(
    events: DataFrame,
    time_column: str,
    profile: Mapping[str, tuple[list[float], list[int]]],
    window: str,
    slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """``window_start, window_end`` and one ``(n, counts)`` struct per feature.

    Works on batch and streaming tables. State is one row of counters per open window,
    whatever the traffic; counters are combined on the map side.
    """
    timed = events.withColumn("_ts", col(time_column).cast("timestamp"))
    if watermark is not None:
        timed = timed.withWatermark("_ts", watermark)
    span = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    cells = []
    for i, (f, (edges, _)) in enumerate(profile.items()):
        x = col(f).cast("double")
        cells += [F.count(x).alias(f"n{i}"), bin_counts(x, edges).alias(f"c{i}")]
    return timed.groupBy(span.alias("w")).agg(*cells)


def _long(counts: DataFrame, profile: Mapping[str, tuple[list[float], list[int]]]) -> DataFrame:
    cells: list[Column] = []
    for i, (f, (_, trained)) in enumerate(profile.items()):
        expected = F.array(*[F.lit(n).cast("bigint") for n in trained]) if trained else F.array().cast("array<bigint>")
        value = psi(expected, F.col(f"c{i}"))
        inside = array_total(F.col(f"c{i}")) if trained else F.col(f"n{i}")
        cells.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"n{i}").alias("n"),
                inside.alias("in_range_rows"),
                value.alias("psi"),
                drift_status(value).alias("status"),
            )
        )
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.inline(F.array(*cells))
    ).where("n > 0")


def drift_by_window(
    events: DataFrame,
    time_column: str,
    profile: Mapping[str, tuple[list[float], list[int]]],
    window: str,
    slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """PSI per window and feature, the same expression for batch and streaming input."""
    return _long(windowed_counts(events, time_column, profile, window, slide, watermark), profile)


def start_drift_monitor(
    events: DataFrame,
    time_column: str,
    profile: Mapping[str, tuple[list[float], list[int]]],
    window: str,
    checkpoint: str,
    watermark: str,
    sink: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Run the monitor. ``append`` emits a window once the watermark has passed it (live
    alerts); ``complete`` re-emits all windows and suits a finite replay."""
    report = drift_by_window(events, time_column, profile, window, None, watermark)
    return (
        report.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .start()
    )
