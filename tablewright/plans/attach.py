"""Joining group statistics back to rows when one group may hold most of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.schema import col
from tablewright.plans.lineage import cut

BROADCAST_GROUPS = 100_000
HOT_FRACTION = 1_000
SALTS = 64
ROWS_PER_SALT = 2_000_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast; never counts past the bound."""
    return df.limit(rows + 1).count() <= rows


def attach_group_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    count_column: str,
    rows: int,
    broadcast_groups: int = BROADCAST_GROUPS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join of one-row-per-key ``stats`` to ``df`` on ``keys``.

    The statistics are written to the checkpoint folder once, since both the size check and
    the join read them. Few keys: they are broadcast and the rows do not move. Many keys: rows of
    keys above ``rows / HOT_FRACTION`` (at most ``HOT_FRACTION`` such keys can exist) are
    spread over at least ``salts`` partitions, more when a key has more than ``ROWS_PER_SALT`` rows for each,
    and only those keys' statistics are replicated. Rows with a NULL key match nothing, so they stay where
    they are with NULL statistics.
    """
    stats = cut(stats)
    if has_at_most(stats, broadcast_groups):
        return df.join(F.broadcast(stats), list(keys), "left")
    limit = max(1, rows // HOT_FRACTION)
    hot = stats.where(F.col(count_column) > limit).select(*keys).withColumn("_hot", F.lit(True))
    absent = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
    marked = df.where(~absent).join(F.broadcast(hot), list(keys), "left")
    others = [c for c in df.columns if c not in keys]
    largest = stats.agg(F.max(count_column)).first()[0] or 0
    salts = max(salts, math.ceil(largest / ROWS_PER_SALT))
    spread = F.pmod(F.xxhash64(*[col(c) for c in (others or keys)]), F.lit(salts)).cast("int")
    left = marked.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col(count_column) > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = stats.withColumn("_salt", F.explode(copies))
    met = left.join(right, [*keys, "_salt"], "left").drop("_salt")
    return met.unionByName(df.where(absent), allowMissingColumns=True)


COPIES_PER_TASK = 1_000_000


def spread_for_copies(
    df: DataFrame, key: Sequence[str], copies: int, copies_per_task: int = COPIES_PER_TASK
) -> DataFrame:
    """Partition narrow rows by key before each becomes ``copies`` rows.

    The task count follows the rows that will exist afterwards, and a later ``groupBy`` on
    the key finds its rows already together.
    """
    tasks = math.ceil(df.count() * copies / copies_per_task)
    return df.repartition(tasks, *[col(k) for k in key]) if tasks > 1 else df


ROWS_PER_PASS_TASK = 20_000
SMALL_TASKS = 32
MOST_ROWS_PER_PASS_TASK = 500_000


def spread_for_passes(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Partition ``rows`` rows by key, and sort them, before an estimator passes over them many times.

    A file of few row groups would keep every pass in few tasks. Small tables get a task for ``ROWS_PER_PASS_TASK``
    rows, ``SMALL_TASKS`` at most; large ones as many as ``MOST_ROWS_PER_PASS_TASK`` asks for. The layout follows the
    rows alone, so bagged samples do not depend on files or cores.
    """
    tasks = min(math.ceil(rows / ROWS_PER_PASS_TASK), max(SMALL_TASKS, math.ceil(rows / MOST_ROWS_PER_PASS_TASK)))
    names = [col(k) for k in key]
    return df.repartition(max(1, tasks), *names).sortWithinPartitions(*names)
