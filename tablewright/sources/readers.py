"""Scans: CSV, Parquet, keyed CSV, JSON documents, JSON lines, artifacts of many runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.schema import nan_to_null

EXPERIMENT_SCHEMA = (
    "timestamp string, output_dir string, params map<string,string>, metrics map<string,double>, "
    "model_info struct<best_model:string,problem_type:string>"
)
MODEL_INFO_SCHEMA = (
    "problem_type string, eval_metric string, label string, features array<string>, best_model string"
)
ANALYSIS_SCHEMA = "findings array<string>, recommendations array<string>"
CV_SCHEMA = "n_folds int, aggregate_scores map<string,struct<mean:double,std:double>>"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """Header row; an explicit schema saves the inference pass over large inputs."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_keyed_csv(spark: SparkSession, path: str | Sequence[str], key: str = "feature") -> DataFrame:
    """CSV whose first column is an unnamed row key."""
    df = read_csv(spark, path)
    return df.withColumnRenamed(df.columns[0], key)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_csv(spark, path, "feature")


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """A path that does not exist is an empty table; every other error stands."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_json_lines(spark: SparkSession, path: str, schema: str = EXPERIMENT_SCHEMA) -> DataFrame:
    """One object per line; blank lines are skipped, a missing path is an empty table."""
    return _or_empty(spark, lambda: spark.read.schema(schema).json(path), schema)


def read_json_document(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """One object per file, with the file it came from in ``_file``."""

    def read() -> DataFrame:
        df = spark.read.schema(schema).json(path, multiLine=True)
        return df.withColumn("_file", F.col("_metadata.file_path"))

    return _or_empty(spark, read, f"{schema}, _file string")


def run_id(artifact: str, file_column: str = "_file"):
    """Name of the directory that holds the artifact (itself a file or a directory of parts)."""
    return F.regexp_extract(file_column, r"([^/]+)/" + re.escape(artifact) + r"(/[^/]*)?$", 1)


def read_run_artifact(
    spark: SparkSession, base: str, artifact: str, schema: str | None = None
) -> DataFrame | None:
    """The same artifact of every run directory under ``base``, keyed by ``run_id``.

    CSV columns are matched by name: there is one scan per distinct header, however many runs share it, and
    a column some runs lack is NULL for them. Returns ``None`` when no run has the artifact.
    """
    path = f"{base.rstrip('/')}/*/{artifact}"
    try:
        if artifact.endswith(".json"):
            reader = spark.read.schema(schema) if schema else spark.read
            df = reader.json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
        else:
            df = _by_header(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return nan_to_null(df.withColumn("run_id", run_id(artifact)).drop("_file"))


def _by_header(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    """Union by name of one scan per distinct header among the files of ``path``, with ``_file``."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    # lines keep their order within the first block of a file
    firsts = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups = firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    frames = []
    for g in groups:
        reader = spark.read.option("header", True)
        if schema is None:
            part = reader.option("inferSchema", True).csv(g["files"])
        else:
            raw = reader.csv(g["files"])
            known = T.StructType.fromDDL(schema)
            typed = {f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in known if f.name in raw.columns}
            part = raw.withColumns(typed) if typed else raw
        frames.append(part.withColumn("_file", F.col("_metadata.file_path")))
    if not frames:
        return spark.createDataFrame([], f"{schema}, _file string" if schema else "_file string")
    return union_ragged(frames)


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
