"""Fitted pipelines stored together with the target statistics they need."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str, mean: float = 0.0, std: float = 1.0) -> None:
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/pipeline")
    stats = spark.createDataFrame([(mean, std)], "y_mean double, y_std double")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/target")


def load_model(path: str):
    stats = SparkSession.active().read.schema("y_mean double, y_std double").json(f"{path}/target").first()
    return PipelineModel.load(f"{path}/pipeline"), stats["y_mean"], stats["y_std"]
