"""Frame lists, metadata, images and artifacts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrum.functions.conditions import frame_id_of_path

METADATA = T.StructType([T.StructField("scraped_weather", T.StringType()), T.StructField("time_of_day", T.StringType())])


def frame_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, frame_id) of the non-blank lines of one text file, in order; lines may be ids or image paths."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return lines.where(F.trim("line") != "").select(F.col("ord").cast("long").alias("ord"), frame_id_of_path(F.col("line")).alias("frame_id"))


def _frame_dir(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def metadata(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """(frame_id, scraped_weather, time_of_day) of root/{frame_id}/metadata.json; unreadable files give nulls."""
    df = spark.read.schema(METADATA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{name}")
    return df.select(_frame_dir(F.col("_metadata.file_path")).alias("frame_id"), "scraped_weather", "time_of_day")


def with_metadata(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Frames with their metadata; has_metadata is false where there is none."""
    return frames.join(meta.withColumn("has_metadata", F.lit(True)), "frame_id", "left").na.fill(False, ["has_metadata"])


def presence(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """For each frame folder which of the named files it has; contents are not read."""
    found = listing(spark, root, "*", recursive=True).select(_frame_dir(F.col("path")).alias("frame_id"), F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").isin(names))
    wide = found.groupBy("frame_id").pivot("name", names).count()
    return wide.select("frame_id", *(F.col(f"`{n}`").isNotNull().alias(n.replace(".", "_")) for n in names))


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length) of files, without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.load(root).select("path", "modificationTime", "length")


def frames_in(spark: SparkSession, root: str, suffix: str = ".png") -> DataFrame:
    """Frame ids of root/frame_*suffix."""
    names = listing(spark, root, f"frame_*{suffix}").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.select(F.replace(F.replace("name", F.lit("frame_"), F.lit("")), F.lit(suffix), F.lit("")).alias("frame_id"))


def latest(files: DataFrame, by: str = "path") -> DataFrame:
    """The last file by name (``path``) or by time (``modificationTime``)."""
    return files.agg(F.max("path").alias("path")) if by == "path" else files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def folder_size(files: DataFrame) -> DataFrame:
    """Files, folders that hold them, and bytes."""
    folder = F.expr("substring_index(path, '/', size(split(path, '/')) - 1)")
    return files.agg(F.count("*").alias("files"), F.count_distinct(folder).alias("folders"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def images(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """(frame_id, h, w, channels, data): decoded images, BGR or grey."""
    df = spark.read.format("image").option("pathGlobFilter", glob).load(root)
    return df.select(frame_id_of_path(F.col("image.origin")).alias("frame_id"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def valid_points(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point records (arrays points_3d and camera_coordinates), and the quarantined ones: missing or of unequal length."""
    ok = F.coalesce((F.size("points_3d") == F.size("camera_coordinates")) & (F.size("points_3d") >= 0), F.lit(False))
    return records.where(ok), records.where(~ok).withColumn("reason", F.when(F.col("points_3d").isNull() | F.col("camera_coordinates").isNull(), "missing").otherwise("lengths differ"))
