"""Saving and loading a trained run on any storage Spark can reach."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tablewright.operators.train import Fitted


def save_run(spark: SparkSession, run: Fitted, path: str) -> None:
    """One pipeline per model under ``path/models`` and a JSON line under ``path/run``."""
    for name, model in run.models.items():
        PipelineModel([run.prepare, model]).save(f"{path}/models/{name}")
    about = {
        "label": run.label, "kind": run.kind, "metric": run.metric, "features": run.features,
        "classes": run.classes, "best": run.best, "weights": run.weights, "threshold": run.threshold,
        "level": run.level, "models": list(run.models),
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/run").first()["value"])
    pipelines = {m: PipelineModel.load(f"{path}/models/{m}") for m in about.pop("models")}
    prepare = next(iter(pipelines.values())).stages[0]
    return Fitted(prepare=prepare, models={m: p.stages[1] for m, p in pipelines.items()}, **about)
