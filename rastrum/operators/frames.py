"""Set operations on frame ids and choices among neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrum.functions.conditions import frame_id_of_path, frame_path


def parsed_ids(lines: DataFrame, col: str = "line") -> DataFrame:
    """Frame ids of the non-blank lines, in file order, with the canonical path."""
    df = lines.where(F.trim(col) != "").withColumn("frame_id", frame_id_of_path(F.col(col)))
    return df.select("ord", "frame_id", frame_path(F.col("frame_id")).alias("path"))


def available(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that both inputs have."""
    return a.select("frame_id").intersect(b.select("frame_id"))


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: wanted frames that are not done yet."""
    return wanted.join(done.select("frame_id").distinct(), "frame_id", "left_anti")


def run_counters(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def sweep_neighbours(sweeps: DataFrame, by: str = "sensor", at: str = "ts", before: int = 1, after: int = 1) -> DataFrame:
    """For each keyframe the ids of the sweeps just before and after it on the same sensor."""
    w = W.partitionBy(by).orderBy(at, "frame_id")
    names = [*(F.lag("frame_id", k).over(w).alias(f"before_{k}") for k in range(1, before + 1)), *(F.lead("frame_id", k).over(w).alias(f"after_{k}") for k in range(1, after + 1))]
    return sweeps.select("frame_id", by, *names, "is_keyframe").where("is_keyframe").drop("is_keyframe")


def arg_extremes(counts: DataFrame, key: str, n: str, order: str) -> DataFrame:
    """Keys of the greatest and the least count; ties: the first by ``order``."""
    return counts.agg(F.min_by(key, F.struct(-F.col(n), order)).alias("most"), F.min_by(key, F.struct(n, order)).alias("least"))
