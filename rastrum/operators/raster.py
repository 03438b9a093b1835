"""Label rules on sparse rasters, one row a cell (frame_id, y, x, ...)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPARSE, ENOUGH = 12, 5  # cells of 49; surviving cells of a class
FAR_BYTE, NEAR_BYTE, NONE_BYTE = 230, 153, 255


def edge(y: Column, height: int, share: float, least: int) -> Column:
    e = max(int(height * share), least)
    return (y < e) | (y >= height - e)


def camera_labels(cells: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """Composited masks, in which background in the edge strips becomes ignore."""
    e = max(int(height * 0.01), 5)
    strip = frames.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).where(edge(F.col("y"), height, 0.01, 5))
    strip = strip.select("frame_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.lit(1).alias("class_id")) if e else strip
    both = cells.select("frame_id", "y", "x", "class_id").unionByName(strip)
    return both.groupBy("frame_id", "y", "x").agg(F.max("class_id").alias("class_id"))


def ignored_edges(rasters: np.ndarray) -> np.ndarray:
    """The rule of camera_labels on dense label rasters (n, h, w)."""
    h = rasters.shape[1]
    e = max(int(h * 0.01), 5)
    y = np.arange(h)
    strip = ((y < e) | (y >= h - e))[None, :, None]
    return np.where(strip & (rasters == 0), np.uint8(1), rasters)


def covered(xb: Column, yb: Column, zb: Column) -> Column:
    return ((xb > 3) | (yb > 3) | (zb > 3)) & (zb < NONE_BYTE)


def density(raster: DataFrame, reach: int = 3) -> DataFrame:
    """Covered cells among the 49 around each covered cell, by two box sums: along x, then along y.

    Each is a range frame of a window, so that neighbours need no join.
    """
    df = raster.where(covered(F.col("xb"), F.col("yb"), F.col("zb")))
    span = 2 * reach + 1
    rows = df.select("frame_id", "y", "x", F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("cx")).groupBy("frame_id", "y", "cx").agg(F.count("*").alias("n"))
    w = W.partitionBy("frame_id", "cx").orderBy("y").rangeBetween(-reach, reach)
    summed = rows.select("frame_id", "y", F.col("cx").alias("x"), F.sum("n").over(w).cast("int").alias("cnt"))
    return df.join(summed, ["frame_id", "y", "x"]).select("frame_id", "y", "x", "xb", "yb", "zb", F.least("cnt", F.lit(span * span)).alias("cnt"))


def lidar_labels(raster: DataFrame, cells: DataFrame, height: int) -> DataFrame:
    """Labels of covered cells: ignore where sparse, far or at the edge; an object class where it is near and enough of it survives; else 0."""
    d = density(raster).join(cells.select("frame_id", "y", "x", F.col("class_id").alias("seg")), ["frame_id", "y", "x"], "left")
    ignore = (F.col("cnt") <= SPARSE) | (F.col("zb") >= FAR_BYTE) | edge(F.col("y"), height, 0.005, 3)
    d = d.withColumn("ignore", ignore).withColumn("own", F.when(F.col("seg").between(2, 5) & ~ignore & (F.col("zb") <= NEAR_BYTE), F.col("seg")))
    n = F.count("own").over(W.partitionBy("frame_id", "own"))
    label = F.when(F.col("ignore"), 1).when(F.col("own").isNotNull() & (n >= ENOUGH), F.col("own")).otherwise(0)
    return d.select("frame_id", "y", "x", label.alias("label"))


def raster_qa(raster: DataFrame, cells: int) -> DataFrame:
    """Per frame and channel: non-zero cells, distinct values, range, share of the raster, and the range in metres."""
    long = raster.select("frame_id", F.expr("stack(3, 'x', xb, 'y', yb, 'z', zb) AS (channel, v)"))
    a = long.groupBy("frame_id", "channel").agg(F.count_if(F.col("v") != 0).alias("nonzero"), F.count_distinct("v").alias("values"), F.min("v").alias("least"), F.max("v").alias("most"))
    metres = lambda c: F.round(F.when(F.col("channel") == "z", F.col(c) / 255 * 100).otherwise(F.col(c) / 255 * 100 - 50), 6)
    return a.select("*", F.round(F.col("nonzero") / cells * 100, 6).alias("density_pct"), metres("least").alias("least_m"), metres("most").alias("most_m"))
