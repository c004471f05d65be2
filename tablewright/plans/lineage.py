"""Cutting lineage on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session may fall back to one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise once on reliable storage; later steps start from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """:func:`cut` for loops that join their own results: the planner takes the size of what is read back from its files.

    A checkpoint hands on the size that was guessed for its plan, and a join's guess is the product of both sides. Round
    by round the digits of that number double, until the numbers fill the driver's heap.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "filed")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_seeing(df: DataFrame, fact: Column, into: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, int]:
    """:func:`cut` (or ``into``), and an aggregate of its rows that is made on the way instead of in a job of its own."""
    seen = Observation()
    out = into(df.observe(seen, fact.alias("fact")))
    return out, seen.get["fact"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, for tables that one step writes and the next reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
