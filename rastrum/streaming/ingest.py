"""Frames as a stream: the same conditions and counts as in batch (an extension; the batch engine does not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rastrum.functions.conditions import condition


def frame_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of frame metadata (frame_id, ts, scraped_weather, time_of_day, has_metadata)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def condition_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Frames by window and condition; a frame counts once however often it arrives within the watermark."""
    c = condition(F.col("scraped_weather"), F.col("time_of_day"), F.col("has_metadata"))
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["frame_id"])
    return once.groupBy(F.window("ts", window), c.alias("condition")).agg(F.count("*").alias("n"))


def write_new(batch: DataFrame, path: str) -> None:
    """A foreachBatch sink that leaves out frames already written, so that a replayed batch changes nothing."""
    try:
        batch = batch.join(batch.sparkSession.read.parquet(path).select("frame_id").distinct(), "frame_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    batch.write.mode("append").parquet(path)
