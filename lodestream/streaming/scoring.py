"""Fitted pipelines kept in the shared folder, and streams that they score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(spark: SparkSession, path: str) -> PipelineModel:
    """The pipeline, in any session that reads the folder."""
    return PipelineModel.read().session(spark).load(path)


def scores_by_window(model: PipelineModel, rows: DataFrame, time: str, width: str, late: str | None = None) -> DataFrame:
    """Rows scored and the mean prediction by tumbling window; the same for tables and streams."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    scored = model.transform(timed.withWatermark(time, late) if late else timed)
    window = scored.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"))
    return window.select(F.col("w.start").alias("start"), "n", "mean")
