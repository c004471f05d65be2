"""Sinks: tables, nested reports, the append-only run log and run-partitioned output."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.readers import EXPERIMENT_SCHEMA


def new_run_id(prefix: str) -> str:
    """Sortable and unique to the microsecond."""
    return f"{prefix}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S_%f')}"


def write_table(df: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet") -> None:
    """Write a table; with ``run_id`` each run is one partition of a shared table."""
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
        writer = df.write.mode("append").partitionBy("run_id")
    else:
        writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    write_table(df, path, fmt="csv")


def write_report(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON."""
    df.write.mode("errorifexists").json(path)


def record_experiment(
    spark: SparkSession,
    log: str,
    output_dir: str,
    params: dict,
    metrics: dict,
    model_info: dict | None = None,
) -> DataFrame:
    """Append one entry; each append is its own file, so writers need no lock."""
    entry = [
        (
            datetime.now(timezone.utc).isoformat(),
            output_dir,
            {k: str(v) for k, v in params.items() if v is not None},
            {k: float(v) for k, v in metrics.items() if v is not None},
            (model_info.get("best_model"), model_info.get("problem_type")) if model_info else None,
        )
    ]
    df = spark.createDataFrame(entry, EXPERIMENT_SCHEMA)
    df.coalesce(1).write.mode("append").json(log)
    return df
