"""Streaming: the scorer is stateless per row, so it runs on streams; rates keep state by window.

An extension beyond the batch operators: predictions that arrive in a folder are scored as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import detect


def read_predictions(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of prediction rows from JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_stream(predictions: DataFrame, bank: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Findings and critical flag of each row, without state."""
    return detect.with_findings(predictions, bank=bank).withColumn("has_critical_error", detect.has_critical("findings"))


def windowed_rates(scored: DataFrame, time: str = "scored_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and model: rows and critical rate; state is dropped once the watermark has passed."""
    return (
        scored.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"), "model")
        .agg(F.count("*").alias("n_segments"), F.avg(F.col("has_critical_error").cast("int")).alias("critical_error_rate"))
    )
