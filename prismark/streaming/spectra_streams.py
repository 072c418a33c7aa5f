"""Spectra that arrive as a stream: fitted row-wise stages run on them unchanged; what needs all rows is summed over windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismark.functions.arrays import mean


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files below path, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def transformed(stream: DataFrame, stages: list[Transformer]) -> DataFrame:
    for stage in stages:
        stream = stage.transform(stream)
    return stream


def window_summary(stream: DataFrame, ts: str = "ts", x: str = "x", window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Rows and mean level of the spectra in tumbling windows of event time; rows later than the watermark are dropped by Spark."""
    level = stream.withWatermark(ts, late).select(F.window(ts, window).alias("w"), mean(F.col(x)).alias("level"))
    return level.groupBy("w").agg(F.count("*").alias("n"), F.avg("level").alias("level")).select(F.col("w.start").alias("start"), "n", "level")


def batch_scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch with a stage whose statistic is of the batch itself (leverage, studentized residuals) and appends it to Parquet.

    A batch that is run again after a failure replaces its own folder, so each is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
