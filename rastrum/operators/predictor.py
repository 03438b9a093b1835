"""The interface of prompted segmentation and a deterministic stand-in.

A predictor gets an image and its boxes and returns one mask a box; real
models load lazily, once a task.  ``BoxFill`` marks the box itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.operators import raster_np


class Predictor(Protocol):
    def masks(self, image: np.ndarray | None, boxes: np.ndarray, height: int, width: int) -> np.ndarray: ...


class BoxFill:
    def masks(self, image: np.ndarray | None, boxes: np.ndarray, height: int, width: int) -> np.ndarray:
        x, y, b = np.arange(width), np.arange(height), boxes[:, :, None]
        return ((y >= b[:, 1]) & (y < b[:, 3]))[:, :, None] & ((x >= b[:, 0]) & (x < b[:, 2]))[:, None, :]


SCHEMA = "frame_id string, h int, w int, status string, data binary"


def composite_masks(boxes: DataFrame, height: int, width: int, make: Callable[[], Predictor] = BoxFill, images: DataFrame | None = None) -> DataFrame:
    """One label raster a frame from its boxes (frame_id, class_id, x0..y1); a frame whose prediction fails has status error and no data.

    ``images`` has (frame_id, h, w, data of three bytes a pixel), one row a
    frame; a frame without one is predicted from its boxes alone.  A task makes
    one predictor, for its first frame, and keeps it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor: Predictor | None = None
        for b in batches:
            ids, items, hs, ws, images_ = (b.column(i) for i in range(5))
            first = items.offsets.to_numpy() - items.offsets[0].as_py()
            rows = np.stack([x.to_numpy() for x in items.flatten().flatten()], axis=1).astype(np.int64)
            status, data = [], []
            for i in range(len(b)):
                seg, own = np.zeros((height, width), dtype=np.uint8), rows[first[i] : first[i + 1]]
                try:
                    predictor = predictor or make()
                    image = np.frombuffer(images_[i].as_py(), np.uint8).reshape(hs[i].as_py(), ws[i].as_py(), 3) if images_[i].is_valid else None
                    for m, c in zip(predictor.masks(image, own[:, 1:], height, width), own[:, 0], strict=True):
                        np.maximum(seg, np.uint8(c), out=seg, where=np.asarray(m, dtype=bool))
                except Exception as e:  # a bad frame must not fail the job
                    status.append(f"error: {type(e).__name__}")
                    data.append(None)
                else:
                    status.append("ok")
                    data.append(seg.tobytes())
            size = [pa.array(np.full(len(b), v, np.int32)) for v in (height, width)]
            yield pa.RecordBatch.from_arrays([ids, *size, pa.array(status, pa.string()), pa.array(data, pa.binary())], names=["frame_id", "h", "w", "status", "data"])

    per = boxes.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("class_id", "x0", "y0", "x1", "y1"))).alias("items"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h", "int"), ("w", "int"), ("data", "binary"))]
    with_image = per.select("*", *none) if images is None else per.join(images.select("frame_id", "h", "w", "data"), "frame_id", "left")
    return with_image.select("frame_id", "items", "h", "w", "data").mapInArrow(run, SCHEMA)


def cells_of(masks: DataFrame) -> DataFrame:
    """Sparse cells (frame_id, y, x, class_id) of label rasters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.filter(t.column("data").is_valid())
            size = t.select(["h", "w"]).to_pandas().to_numpy()
            for h, w in np.unique(size, axis=0).tolist():
                own = t.filter(pa.array((size == (h, w)).all(axis=1)))
                rasters = np.frombuffer(b"".join(own.column("data").to_pylist()), np.uint8).reshape(len(own), h, w)
                yield raster_np.sparse(own.column("frame_id").combine_chunks(), rasters)

    return raster_np.cells_of(masks.select("frame_id", "h", "w", "data").mapInArrow(run, raster_np.SPARSE))
