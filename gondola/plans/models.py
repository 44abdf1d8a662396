"""Saving and loading trained models in one folder of shared storage.

Fitted stages use Spark ML's own format; trees, coefficients and names are Parquet.
Saving replaces whatever an earlier training left.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gondola.functions.boosting import loaded_classes, saved_classes
from gondola.operators.patterns import PatternModel
from gondola.operators.stock import StockModel


def save_pipeline(model: PipelineModel, path: str, name: str) -> None:
    model.write().overwrite().save(f"{path}/{name}")


def load_pipeline(path: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{name}")


def save_table(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write a frame and return it as read back, so later steps start from the file."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def save_stock(model: StockModel, path: str) -> None:
    save_pipeline(model.scaler, path, "stock_scaler")
    save_table(saved_classes(model.trees).coalesce(1), path, "stock_trees")


def load_stock(spark: SparkSession, path: str) -> StockModel:
    return StockModel(load_pipeline(path, "stock_scaler"),
                      loaded_classes(load_table(spark, path, "stock_trees")))


def save_patterns(spark: SparkSession, model: PatternModel, path: str) -> None:
    save_pipeline(model.pipeline, path, "patterns")
    names = spark.createDataFrame(list(model.names.items()), "Cluster bigint, Pattern string")
    save_table(names.coalesce(1), path, "pattern_names")


def load_patterns(spark: SparkSession, path: str) -> PatternModel:
    # At most eight rows.
    names = {r["Cluster"]: r["Pattern"] for r in load_table(spark, path, "pattern_names").collect()}
    return PatternModel(load_pipeline(path, "patterns"), names)
