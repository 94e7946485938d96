"""Model persistence (S13): fitted state as Parquet tables / Spark ML formats."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .csv_logs import _exists


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_detector(det, path: str) -> None:
    """Isolation-forest node table, one-class weights, scaler stats and, where
    the batch has been scored, the frozen score range."""
    save_table(det.forest, f"{path}/forest")
    save_table(det.ocsvm, f"{path}/ocsvm")
    save_table(det.stats, f"{path}/stats")
    if det.range is not None:
        save_table(det.range, f"{path}/range")


def load_detector(spark: SparkSession, path: str, features: list[str], name: str = "detector"):
    from ..operators.detect import Detector
    span = load_table(spark, f"{path}/range") if _exists(spark, f"{path}/range") else None
    return Detector(name, features, load_table(spark, f"{path}/stats"),
                    load_table(spark, f"{path}/forest"), load_table(spark, f"{path}/ocsvm"), span)


def save_ml_model(model, path: str) -> None:
    """Spark ML models (K-Means)."""
    model.write().overwrite().save(path)


def load_ml_model(path: str) -> PipelineModel:
    """A stored K-Means pipeline."""
    return PipelineModel.load(path)


def save_classifier(model, path: str) -> None:
    """Node table, class names and bin bounds of a fitted classifier."""
    save_table(model.nodes, f"{path}/nodes")
    row = [(model.labels, model.trees, list(model.splits), list(model.splits.values()))]
    save_table(model.nodes.sparkSession.createDataFrame(
        row, "labels array<string>, trees int, features array<string>, bounds array<array<double>>"), f"{path}/bins")


def load_classifier(spark: SparkSession, path: str):
    from ..operators.forest import Forest
    row = load_table(spark, f"{path}/bins").first()
    return Forest(row["labels"], row["trees"], dict(zip(row["features"], row["bounds"])), load_table(spark, f"{path}/nodes"))
