"""Boundary rules of boxes, masks, points and rasters."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rastrum.operators import boxes, geometry, predictor, raster, raster_np

OBJECT = "frame_id string, seq int, name string, box2d struct<xmin: double, ymin: double, xmax: double, ymax: double>"
BOX = "frame_id string, seq int, class_id int, x0 int, y0 int, x1 int, y1 int, area long"


@pytest.mark.parametrize(
    ("name", "box", "kept"),
    [
        ("Vehicle", (0, 0, 30, 30), True),
        ("Vehicle", (0, 0, 29, 30), False),
        ("TrafficSign", (0, 0, 15, 15), True),
        ("TrafficSign", (0, 0, 400, 100), True),  # 0.4 of the width
        ("TrafficSign", (0, 0, 401, 100), False),
        ("PoleObject", (0, 0, 160, 20), True),  # aspect 8
        ("PoleObject", (0, 0, 161, 20), False),
        ("Animal", (0, 0, 50, 50), False),
        ("Pedestrian", None, False),
    ],
)
def test_filter(spark, name, box, kept):
    df = spark.createDataFrame([("f", 0, name, tuple(map(float, box)) if box else None)], OBJECT)
    assert (boxes.usable_boxes(df, 1000, 1000).count() == 1) == kept


def test_clip(spark):
    df = spark.createDataFrame([("f", 0, "Pedestrian", (-5.9, -0.5, 20.9, 30.2))], OBJECT)
    r = boxes.usable_boxes(df, 100, 100).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) == (0, 0, 20, 30, 600)
    assert [r["status"] for r in boxes.frame_status(df, boxes.usable_boxes(df, 100, 100).where("false")).collect()] == ["failed"]


def folded(rows):
    """The merge as plain loops."""
    kept = []
    for *_, x0, y0, x1, y1, _ in sorted(rows, key=lambda r: (-r[7], r[1])):
        for k in kept:
            w, h = min(x1, k[2]) - max(x0, k[0]), min(y1, k[3]) - max(y0, k[1])
            i = w * h if w >= 0 and h >= 0 else 0
            u = (x1 - x0) * (y1 - y0) + (k[2] - k[0]) * (k[3] - k[1]) - i
            if u > 0 and i / u > 0.3:
                k[:] = [min(k[0], x0), min(k[1], y0), max(k[2], x1), max(k[3], y1)]
                break
        else:
            kept.append([x0, y0, x1, y1])
    return kept


def test_merge_equals_a_fold(spark):
    r = random.Random(3)
    rows = []
    for f in range(40):
        for s in range(r.randint(1, 9)):
            x, y, w, h = r.randint(0, 60), r.randint(0, 60), r.randint(15, 50), r.randint(15, 50)
            rows.append((str(f), s, r.choice([2, 3]), x, y, x + w, y + h, w * h))
    got = {}
    for b in boxes.merged_boxes(spark.createDataFrame(rows, BOX)).orderBy("pos").collect():
        got.setdefault((b["frame_id"], b["class_id"]), []).append([b["x0"], b["y0"], b["x1"], b["y1"]])
    want = {k: folded([x for x in rows if (x[0], x[2]) == k]) for k in {(x[0], x[2]) for x in rows}}
    assert got == want


@pytest.mark.parametrize(("second", "n"), [((10, 0, 20, 10), 2), ((4, 0, 14, 10), 1), ((0, 0, 10, 3), 2)])
def test_touching_and_equal_overlap(spark, second, n):
    """Touching boxes stay; 60 / 140 merges; an overlap of exactly 0.3 stays."""
    area = (second[2] - second[0]) * (second[3] - second[1])
    df = spark.createDataFrame([("f", 0, 3, 0, 0, 10, 10, 100), ("f", 1, 3, *second, area)], BOX)
    assert boxes.merged_boxes(df).count() == n


def test_cap(spark):
    rows = [("f", i, 3, 20 * i, 0, 20 * i + 15, 15 + i % 3, 15 * (15 + i % 3)) for i in range(76)]
    m = boxes.merged_boxes(spark.createDataFrame(rows, BOX))
    assert boxes.capped_boxes(m).count() == 75 and boxes.capped_boxes(m.where("x0 > 0")).count() == 75
    assert boxes.capped_boxes(m).agg({"area": "min"}).first()[0] == 225


def test_composite_and_predictor(spark):
    cells = spark.createDataFrame([("f", 0, 0, 5), ("f", 0, 0, 3), ("f", 0, 1, 2)], "frame_id string, y int, x int, class_id int")
    assert sorted(tuple(r) for r in boxes.composite(cells).collect()) == [("f", 0, 0, 5), ("f", 0, 1, 2)]
    b = spark.createDataFrame([("f", 0, 5, 0, 0, 2, 1, 2), ("f", 1, 3, 1, 0, 3, 1, 2)], BOX)
    got = predictor.cells_of(predictor.composite_masks(b, 2, 4)).collect()
    assert sorted(tuple(r) for r in got) == [("f", 0, 0, 5), ("f", 0, 1, 5), ("f", 0, 2, 3)]

    class Broken:
        def masks(self, *a):
            raise ValueError

    r = predictor.composite_masks(b, 2, 4, Broken).first()
    assert r["status"] == "error: ValueError" and r["data"] is None


CAM = geometry.Camera([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], 100.0, 100.0, 50.0, 50.0, (0, 0, 0, 0), 1.5, 100, 100)
POINT = "frame_id string, idx long, x double, y double, z double"


def test_projection(spark):
    rows = [("f", 0, 0.0, 0.0, 5.0), ("f", 1, 0.0, 0.0, -1.0), ("f", 2, 100.0, 0.0, 1.0), ("f", 3, 0.0, 0.0, 0.0)]
    got = geometry.project(spark.createDataFrame(rows, POINT), CAM).collect()
    assert [(r["idx"], r["px"], r["py"]) for r in got] == [(0, 50, 50)]
    half = geometry.Camera(CAM.rows, 100.0, 100.0, 10.5, 11.5, CAM.k, 1.5, 100, 100)
    r = geometry.project(spark.createDataFrame(rows[:1], POINT), half).first()
    assert (r["px"], r["py"]) == (10, 12)  # half to even
    for cx, n in ((9.99, 0), (10.0, 1), (90.0, 0)):
        assert geometry.project(spark.createDataFrame(rows[:1], POINT), geometry.Camera(CAM.rows, 1.0, 1.0, cx, 50.0, CAM.k, 1.5, 100, 100)).count() == n


def test_calibrated_projection_equals_the_literal_one(spark):
    lidar, cam = [[0, -1, 0, 0.5], [1, 0, 0, -0.2], [0, 0, 1, 0.1], [0, 0, 0, 1]], [[1, 0, 0, 0.3], [0, 0, -1, 0], [0, 1, 0, 1.0], [0, 0, 0, 1]]
    r = random.Random(4)
    points = spark.createDataFrame([("f", i, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(300)] + [("g", 0, 1.0, 1.0, 1.0)], POINT)
    dist = (0.05, -0.01, 0.002, -0.0005)
    flat = lambda m: [float(v) for row in m for v in row]
    calib = spark.createDataFrame([("f", 3, flat(lidar), flat(cam), [300.0, 0.0, 320.0, 0.0, 310.0, 240.0, 0.0, 0.0, 1.0], list(dist), 1.2, 640, 480)], "frame_id string, camera_id int, t_lidar array<double>, t_cam array<double>, k array<double>, dist array<double>, fov double, w int, h int")
    literal = geometry.Camera(geometry.lidar_to_camera(lidar, cam), 300.0, 310.0, 320.0, 240.0, dist, 1.2, 640, 480)
    want = {(r["idx"], r["px"], r["py"]) for r in geometry.project(points.where("frame_id = 'f'"), literal).collect()}
    got = geometry.calibrated(points, calib).collect()
    assert {(r["idx"], r["px"], r["py"]) for r in got} == want and len(want) > 20 and {r["camera_id"] for r in got} == {3}


def test_raster_keeps_the_last_point(spark):
    df = spark.createDataFrame([("f", 0, 1, 10, 10, -50.0, 0.0, 0.0), ("f", 1, 1, 10, 10, 0.0, 50.0, 60.0), ("f", 2, 2, 10, 10, 9.0, 9.0, 9.0)], "frame_id string, idx long, camera_id int, px int, py int, x double, y double, z double")
    r = geometry.rasterise(df, 100, 100, 100, 100).collect()
    assert [tuple(x) for x in r] == [("f", 10, 10, 127, 255, 153)]
    assert [tuple(x) for x in geometry.front_share(df).collect()] == [("f", 3, 2, False)]
    d = geometry.decoded(geometry.rasterise(df, 100, 100, 100, 100)).first()
    assert d["mz"] == pytest.approx(60.0)


def test_sizes(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(2168, 3848)], "h int, w int").select(geometry.resized(F.col("h"), F.col("w")).alias("s")).first()["s"]
    assert tuple(r) == (1024, 576, 1363, 768)


def reference_labels(r, seg, h):
    """The label rules on a dense raster, step by step."""
    x, y, z = (r[:, :, i].astype(int) for i in range(3))
    cov = ((x > 3) | (y > 3) | (z > 3)) & (z < 255)
    cnt = raster_np.box_count(cov)
    edge = np.zeros_like(cov)
    edge[:3] = edge[h - 3 :] = True
    ignore = cov & ((cnt <= 12) | (z >= 230) | edge)
    out = np.zeros(cov.shape, int)
    out[ignore] = 1
    for c in range(2, 6):
        over = cov & (seg == c)
        if over.sum() >= 5:
            ok = over & (cnt >= 6) & (z <= 153) & ~ignore
            if ok.sum() >= 5:
                out[ok] = c
    return cov, out


def test_lidar_labels(spark):
    rng = np.random.default_rng(0)
    h, w = 20, 24
    cells, masks, want = [], [], set()
    for f in range(6):
        r = rng.integers(0, 256, (h, w, 3)) * (rng.random((h, w, 1)) < 0.15 + 0.15 * f)
        r[:, :, 2] = np.where(rng.random((h, w)) < 0.6, r[:, :, 2] % 154, r[:, :, 2])
        seg = rng.choice([0, 2, 3, 4, 5], (h, w), p=[0.5, 0.3, 0.15, 0.04, 0.01])
        cov, out = reference_labels(r, seg, h)
        cells += [(str(f), int(y), int(x), *map(int, r[y, x])) for y, x in zip(*np.nonzero(r.any(axis=2)), strict=True)]
        masks += [(str(f), int(y), int(x), int(seg[y, x])) for y, x in zip(*np.nonzero(seg), strict=True)]
        want |= {(str(f), int(y), int(x), int(out[y, x])) for y, x in zip(*np.nonzero(cov), strict=True)}
    got = raster.lidar_labels(spark.createDataFrame(cells, "frame_id string, y int, x int, xb int, yb int, zb int"), spark.createDataFrame(masks, "frame_id string, y int, x int, class_id int"), h)
    assert {tuple(r) for r in got.collect()} == want and len({v for *_, v in want}) >= 4


def enhanced_by_loops(a):
    """Blur, gap filling, dilation and scaling of each channel, cell by cell."""
    h, w, _ = a.shape
    weight = [math.exp(-(i * i) / 2) for i in range(-3, 4)]
    weight = [x / sum(weight) for x in weight]
    reach = {-3: 0, -2: 2, -1: 3, 0: 3, 1: 3, 2: 2, 3: 0}
    element = [(dy, dx) for dy, n in reach.items() for dx in range(-n, n + 1)]
    out = np.zeros(a.shape)
    for c in range(a.shape[2]):
        at = lambda v, y, x: v[y][x] if 0 <= y < h and 0 <= x < w else 0.0
        most = lambda v, y, x: max(at(v, y + dy, x + dx) for dy, dx in element)
        grid = lambda f: [[f(y, x) for x in range(w)] for y in range(h)]
        v = a[:, :, c].astype(float).tolist()
        v = grid(lambda y, x: sum(weight[i + 3] * weight[j + 3] * at(v, y + i, x + j) for i in range(-3, 4) for j in range(-3, 4)))
        full = [(y, x) for y in range(h) for x in range(w) if v[y][x] > 0]
        if full:
            near = grid(lambda y, x: min(math.hypot(y - p, x - q) for p, q in full))
            v = grid(lambda y, x: most(v, y, x) / (near[y][x] + 1) if 0 < near[y][x] <= 3 else v[y][x])
        d = v
        for _ in range(3):
            d = grid(lambda y, x: most(d, y, x))
        v = grid(lambda y, x: d[y][x] if v[y][x] <= 0 else v[y][x])
        top = max(map(max, v))
        out[:, :, c] = [[x / top * 255 if top > 0 else x for x in row] for row in v]
    return out


@pytest.mark.parametrize("channels", [(0, 1, 2), (0,), ()])
def test_enhanced_raster_equals_loops(channels):
    """Values above 255 before the blur, channels that differ in what they cover, and empty ones."""
    rng = np.random.default_rng(7)
    a = np.zeros((22, 26, 3), dtype=np.float32)
    for c in channels:
        for _ in range(3):
            a[rng.integers(22), rng.integers(26), c] = rng.random() * 765
    got, want = raster_np.enhanced(a), enhanced_by_loops(a)
    assert got.dtype == np.uint8 and (np.abs(got - np.floor(want + 1e-9)) <= (np.abs(want - np.rint(want)) < 1e-6)).all()


def test_enhanced_points(spark):
    """Out of range to either side: clipped before the weight, which is 0.2 far away and 3 near by."""
    from pyspark.sql import functions as F

    rows = [(90.0, 40.0, 200.0), (-90.0, -40.0, 0.1), (0.0, 0.0, 2.0), (90.0, 15.1, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = [tuple(r) for r in df.select(*geometry.enhanced(F.col("x"), F.col("y"), F.col("z"))).collect()]
    for (x, y, z), g in zip(rows, got, strict=True):
        w = min(3.0, max(0.2, 3 / (z + 1)))
        want = [min(255.0, min(1.0, max(0.0, u)) * 255 * w) * w for u in ((x + 30) / 60, (y + 15) / 30, math.log(z + 1) / math.log(121))]
        assert g == pytest.approx(want)
    assert got[0] == pytest.approx((10.2, 10.2, 10.2)) and got[3][0] == pytest.approx(765)


def test_predictor_is_made_once_and_sees_images(spark, tmp_path):
    b = spark.createDataFrame([(str(i), 0, 5, 0, 0, 2, 1, 2) for i in range(6)], BOX).coalesce(1)
    images = spark.createDataFrame([("0", 1, 2, bytearray([9] * 6)), ("9", 1, 2, bytearray(6))], "frame_id string, h int, w int, data binary")
    log = str(tmp_path / "made")

    class Bright:
        def __init__(self):
            with open(log, "a") as f:
                f.write("x")

        def masks(self, image, boxes, height, width):
            return np.full((len(boxes), height, width), image is not None and image.shape == (1, 2, 3) and image[0, 0, 0] == 9)

    got = predictor.composite_masks(b, 2, 4, Bright, images).repartition(1).collect()
    assert {r["frame_id"]: sum(r["data"]) for r in got} == {"0": 40} | {str(i): 0 for i in range(1, 6)}
    assert 1 <= len(open(log).read()) <= 4  # one a task


def test_camera_strips(spark):
    cells = spark.createDataFrame([("f", 0, 0, 4), ("f", 10, 0, 2)], "frame_id string, y int, x int, class_id int")
    got = {(r["y"], r["x"]): r["class_id"] for r in raster.camera_labels(cells, cells, 2, 768).collect()}
    assert {y for y, _ in got} == {*range(7), *range(761, 768), 10} and got[0, 0] == 4 and got[0, 1] == 1 and got[10, 0] == 2


def test_kernels():
    rng = np.random.default_rng(1)
    m = rng.random((13, 17)) < 0.3
    p = np.pad(m, 3)
    assert (raster_np.box_count(m) == [[p[y : y + 7, x : x + 7].sum() for x in range(17)] for y in range(13)]).all()
    lab, area = raster_np.components(m)
    seen, sizes = np.zeros_like(m), []
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            stack, n = [(y, x)], 0
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                n += 1
                assert lab[a, b] == lab[y, x]
                for c in range(max(0, a - 1), min(13, a + 2)):
                    for d in range(max(0, b - 1), min(17, b + 2)):
                        if m[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            sizes.append(n)
    assert area.tolist() == sizes and (lab > 0).tolist() == m.tolist()
    d = raster_np.distance(m)
    ys, xs = np.nonzero(m)
    for y in range(13):
        for x in range(17):
            assert d[y, x] == pytest.approx(np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()))
    one = np.zeros((9, 9, 3))
    one[4, 4] = 100
    g = raster_np.gaussian(one)
    assert g.sum() == pytest.approx(one.sum()) and g[4, 4, 0] == g.max()
    assert raster_np.gap_filled(one)[4, 5, 0] == pytest.approx(50) and raster_np.gap_filled(one)[4, 6, 0] == pytest.approx(100 / 3)
    assert [int((raster_np.dilated(one, 1)[y, :, 0] > 0).sum()) for y in range(9)] == [0, 1, 5, 7, 7, 7, 5, 1, 0]
    assert raster_np.max_scaled(one).max() == 255
    a = rng.integers(0, 255, (4, 6)).astype(np.uint8)
    assert (raster_np.nearest(a, 8, 12)[::2, ::2] == a).all() and (raster_np.bilinear(a, 4, 6) == a).all()
    image = np.full((4, 6, 3), 100, np.uint8)
    assert raster_np.overlay(image, (a > 128).astype(int) * 2).shape == image.shape
    assert (raster_np.outlined(image, [(1, 1, 4, 3)])[1, 1] == 255).all()
