"""Masks by batches of frames: the same cells as row by row, and plans without a row a cell."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from rastrum.operators import boxes, curation, predictor, raster, raster_np

SF = "/root/testdata/sf0.001"
BOX = "frame_id string, seq int, class_id int, x0 int, y0 int, x1 int, y1 int, area long"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_boxes(frames=60):
    r = random.Random(5)
    rows = []
    for f in range(frames):
        for s in range(r.randint(1, 90 if f == 7 else 9)):
            x, y, w, h = r.randint(0, 300), r.randint(0, 200), r.randint(15, 90), r.randint(15, 60)
            rows.append((f"{f:03d}" if f else None, s, r.choice([2, 3, 4, 5]), x, y, x + w, y + h, w * h))
    return rows


@tables
def test_coordinates_are_computed_once(spark):
    """One look-up of the class for the filter on it and one for the row; each corner is cut once."""
    p = plan(entry.queries()["resume_frames"](spark, SF))
    assert p.count("element_at") == 2 and p.count("greatest(0") == 2, p


@pytest.mark.parametrize("batch", ["7", "2000"])
def test_masks_equal_cells(spark, batch):
    """Frames that go on in the next batch, more boxes than the cap, a null frame."""
    df = spark.createDataFrame(some_boxes(), BOX)
    want = boxes.composite(boxes.grid_cells(boxes.capped_boxes(boxes.merged_boxes(df)), 400, 300, 32, 24))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        merged = boxes.merged_boxes(df)
        got = raster_np.cells_of(boxes.masks(merged, 400, 300, 32, 24, raster_np.sparse, raster_np.SPARSE)).collect()
        per = boxes.masks(merged, 400, 300, 32, 24, curation.raster_classes, curation.CLASSES).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want.collect())))
    assert sorted(map(repr, per)) == sorted(map(repr, curation.frame_classes(want, 32 * 24).collect()))


@tables
@pytest.mark.parametrize("name", ["mask_composite", "frame_class_histogram", "frame_object_stats", "dominant_class", "camera_labels", "mask_components", "mask_resized", "prompt_masks"])
def test_no_hash_entry_a_cell(spark, name):
    p = plan(entry.queries()[name](spark, SF)).split("== Initial Plan ==")[0]
    assert " HashAggregate(" not in p and "FlatMapGroupsInPandas" not in p and "MapInPandas" not in p, p
    assert p.count("Exchange hashpartitioning") + p.count("Exchange REPARTITION") <= 3


def test_regions_equal_components():
    """Rings, diagonals and empty rasters among random ones."""
    rng = np.random.default_rng(2)
    a = np.stack([rng.choice([0, 2, 3, 5], (9, 11), p=[p, (1 - p) / 2, (1 - p) / 4, (1 - p) / 4]) for p in np.linspace(0, 1, 40)]).astype(np.uint8)
    a[3], a[4] = np.eye(9, 11, dtype=np.uint8) * 4, 2
    a[4, 1:-1, 1:-1] = 0
    a[4, 3:-3, 3:-3] = 2
    want = [(f, int(c), i + 1, int(n)) for f in range(len(a)) for c in np.unique(a[f][a[f] > 0]) for i, n in enumerate(raster_np.components(a[f] == c)[1])]
    assert list(zip(*(x.tolist() for x in raster_np.regions(a)), strict=True)) == want
    assert all(len(x) == 0 for x in raster_np.regions(a[-1:]))


def test_areas_and_edges_of_stacks():
    rng = np.random.default_rng(3)
    a = rng.choice([0, 2, 5], (6, 12, 8), p=[0.6, 0.3, 0.1]).astype(np.uint8)
    a[5] = 0
    got = raster_np.class_areas(pa.array(list("abcdef")), a).to_pydict()
    want = [("abcdef"[f], c, int((a[f] == c).sum())) for f in range(6) for c in (2, 5) if (a[f] == c).any()]
    assert list(zip(*got.values(), strict=True)) == want
    edges = raster.ignored_edges(a)
    assert (edges[:, 5:7] == a[:, 5:7]).all() and (edges[:, :5] == np.maximum(a[:, :5], 1)).all() and (edges[:, 7:] == np.maximum(a[:, 7:], 1)).all()


def test_dense_takes_frames_across_batches(spark):
    cells = [(f"{i % 5}", y, x, i + y + x) for i in range(5) for y in range(6) for x in range(7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = raster_np.dense(spark.createDataFrame(cells, "frame_id string, y int, x int, v int"), 6, 7, ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert {r["frame_id"]: np.frombuffer(r["data"], np.uint8).reshape(6, 7).tolist() for r in got} == {f"{i}": [[i + y + x for x in range(7)] for y in range(6)] for i in range(5)}


def test_predicted_masks_of_several_sizes(spark):
    """Cells of rasters of different sizes in one batch, and of none where the prediction failed."""
    rows = [("a", 1, 2, "ok", bytearray([0, 3])), ("b", 2, 1, "ok", bytearray([4, 5])), ("c", 1, 2, "error: X", None)]
    masks = spark.createDataFrame(rows, predictor.SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in predictor.cells_of(masks).collect()) == [("a", 0, 1, 3), ("b", 0, 0, 4), ("b", 1, 0, 5)]
