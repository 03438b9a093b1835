"""From annotated boxes to composited label rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrum.functions.conditions import class_of
from rastrum.operators import raster_np

VEHICLE = 2
MIN_SIZE, MIN_VEHICLE = 15, 30
MAX_SHARE, MAX_ASPECT = 0.4, 8.0
MERGE_IOU = 0.3
CAP = 75


def usable_boxes(objects: DataFrame, img_w: int, img_h: int) -> DataFrame:
    """Boxes of mapped classes, as clipped integers, that are neither small, large nor thin.

    Coordinates are cut towards zero before they are clipped; sizes equal to a
    limit are kept.
    """
    b, class_id = F.col("box2d"), class_of(F.col("name"))
    box = F.struct(
        class_id.alias("class_id"),
        F.greatest(F.lit(0), b["xmin"].cast("int")).alias("x0"),
        F.greatest(F.lit(0), b["ymin"].cast("int")).alias("y0"),
        F.least(F.lit(img_w), b["xmax"].cast("int")).alias("x1"),
        F.least(F.lit(img_h), b["ymax"].cast("int")).alias("y1"),
    )
    # filters move through a projection and then repeat its expressions for each use, but not through a generator
    df = objects.where(b.isNotNull() & class_id.isNotNull()).select("frame_id", "seq", F.inline(F.array(box)))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    least = F.when(F.col("class_id") == VEHICLE, MIN_VEHICLE).otherwise(MIN_SIZE)
    df = df.where((w >= least) & (h >= least) & (w <= MAX_SHARE * img_w) & (h <= MAX_SHARE * img_h))
    return df.where(F.greatest(w, h) / F.least(w, h) <= MAX_ASPECT).withColumn("area", (w * h).cast("bigint"))


def frame_status(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """ok or failed for each frame, by whether any box is left."""
    n = boxes.groupBy("frame_id").agg(F.count("*").alias("n_boxes"))
    return frames.select("frame_id").distinct().join(n, "frame_id", "left").select("frame_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.when(F.col("n_boxes") > 0, "ok").otherwise("failed").alias("status"))


def _iou(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inter = F.when((w >= 0) & (h >= 0), w * h).otherwise(0)
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """Greedy merge within frame and class, as a fold over boxes by falling area.

    The first kept box that overlaps by more than MERGE_IOU grows in place to
    the union rectangle, which later boxes are then tested against.  One
    exchange by frame serves this and all later steps by frame.
    """
    box = F.struct(*(F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    items = F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("k"), "seq", box.alias("b"))))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<x0:INT,y0:INT,x1:INT,y1:INT>>)")

    def union(a: Column, b: Column) -> Column:
        return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))

    def step(kept: Column, item: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: _iou(item["b"], k) > MERGE_IOU), True)
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == hit, union(k, item["b"])).otherwise(k))
        return F.when(hit > 0, grown).otherwise(F.array_append(kept, item["b"]))

    grouped = boxes.repartition("frame_id").groupBy("frame_id", "class_id").agg(F.min("seq").alias("first_seq"), items.alias("items"))
    folded = grouped.select("frame_id", "class_id", "first_seq", F.posexplode(F.aggregate("items", empty, step)).alias("pos", "b"))
    out = folded.select("frame_id", "class_id", "first_seq", "pos", "b.x0", "b.y0", "b.x1", "b.y1")
    return out.withColumn("area", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint"))


def capped_boxes(boxes: DataFrame, cap: int = CAP) -> DataFrame:
    """The ``cap`` largest boxes of each frame; equal areas by class order of appearance, then order in the class."""
    return boxes.selectExpr("*", "row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, first_seq, class_id, pos) AS place").where(F.col("place") <= cap)


def grid_cells(boxes: DataFrame, img_w: int, img_h: int, grid_w: int, grid_h: int) -> DataFrame:
    """The cells of a small grid that each box covers: the deterministic stand-in for prompted masks."""
    lo = lambda c, g, n: F.expr(f"CAST(floor({c} * {g} / {n}) AS INT)")
    hi = lambda c, g, n: F.expr(f"CAST(floor(({c} - 1) * {g} / {n}) AS INT)")
    df = boxes.select("frame_id", "class_id", F.explode(F.sequence(lo("y0", grid_h, img_h), hi("y1", grid_h, img_h))).alias("y"), lo("x0", grid_w, img_w).alias("a"), hi("x1", grid_w, img_w).alias("b"))
    return df.select("frame_id", "y", F.explode(F.sequence("a", "b")).alias("x"), "class_id")


def composite(cells: DataFrame) -> DataFrame:
    """One class a cell: priority is the class id, so that order does not matter."""
    return cells.groupBy("frame_id", "y", "x").agg(F.max("class_id").alias("class_id"))


def masks(merged: DataFrame, img_w: int, img_h: int, grid_w: int, grid_h: int, kernel: Callable[[pa.Array, np.ndarray], pa.RecordBatch], schema: str, cap: int = CAP) -> DataFrame:
    """What ``kernel`` makes of the ids and composited label rasters of frames, some hundreds at a time.

    The same cells as those of ``composite(grid_cells(capped_boxes(...)))``,
    without a row or a hash entry a cell: the cap leaves each frame's boxes in
    one task and in sequence, so that a task holds the rasters of one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, frame, t in raster_np.whole_frames(batches):
            c, x0, y0, x1, y1 = (t.column(k).to_numpy().astype(np.int64) for k in ("class_id", "x0", "y0", "x1", "y1"))
            y, x = (y0 * grid_h // img_h, (y1 - 1) * grid_h // img_h), (x0 * grid_w // img_w, (x1 - 1) * grid_w // img_w)
            yield kernel(ids, raster_np.painted(frame.astype(np.int64), c, y, x, len(ids), grid_h, grid_w))

    placed = capped_boxes(merged, cap).select("frame_id", "class_id", "x0", "y0", "x1", "y1")
    return placed.sortWithinPartitions("frame_id").mapInArrow(run, schema)  # sorted already: no sort is planned
