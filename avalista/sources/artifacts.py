"""Saved models: one folder per model, stages as Spark ML, figures as a one-row table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from avalista.plans.training import SEGMENTS, RiskModel

STAGES = ["preprocessor", "pd_model", "calibrator", "lgd_model"]


def save_artifacts(model: RiskModel, path: str, spark: SparkSession) -> None:
    for name in STAGES:
        getattr(model, name).write().overwrite().save(f"{path}/{name}")
    factors = [(x, label, float(f)) for x, table in model.segment_factors.items() for label, f in table.items()]
    spark.createDataFrame(factors, "segment string, label string, factor double").coalesce(1).write.mode("overwrite").parquet(f"{path}/segment_factors")
    row = {"calibration_factor": float(model.factor), **model.metadata}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_artifacts(spark: SparkSession, path: str) -> RiskModel:
    """Load a saved model; a missing one fails here, not at the first quote."""
    row = spark.read.parquet(f"{path}/metadata").first().asDict()
    factor = row.pop("calibration_factor")
    stages = {
        name: PipelineModel.load(f"{path}/{name}") if name == "preprocessor" else _load_stage(f"{path}/{name}", spark)
        for name in STAGES
    }
    factors: dict[str, dict[str, float]] = {x: {} for x in SEGMENTS}
    for r in spark.read.parquet(f"{path}/segment_factors").collect():  # a handful of labels
        factors[r["segment"]][r["label"]] = r["factor"]
    return RiskModel(factor=factor, metadata=row, segment_factors=factors, **stages)


def _load_stage(path, spark):
    return DefaultParamsReader.loadParamsInstance(path, spark)
