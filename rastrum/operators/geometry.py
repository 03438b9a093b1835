"""Point geometry: rigid transforms, fisheye projection, rasters of points.

All native expressions.  The projection is the published Kannala-Brandt (2006)
model with four coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIVE_W, NATIVE_H = 3848, 2168
TARGET_W, TARGET_H = 1363, 768
MARGIN = 10


@dataclass(frozen=True)
class Camera:
    """Numbers, or columns where each row has its own camera: extrinsic rows (3 x 4, LiDAR to camera), focal lengths, centre, distortion, half field of view, image size."""

    rows: Sequence[Sequence[float]]
    fx: float
    fy: float
    cx: float
    cy: float
    k: Sequence[float]
    half_fov: float
    width: int
    height: int


def lidar_to_camera(t_lidar: Sequence[Sequence[float]], t_cam: Sequence[Sequence[float]]) -> list[list[float]]:
    """inv(T_cam) @ T_lidar of rigid 4 x 4 transforms, without its last row."""
    r = [[t_cam[j][i] for j in range(3)] for i in range(3)]
    t = [-sum(r[i][j] * t_cam[j][3] for j in range(3)) for i in range(3)]
    inv = [[*r[i], t[i]] for i in range(3)]
    full = [*t_lidar[:3], [0.0, 0.0, 0.0, 1.0]]
    return [[sum(inv[i][k] * full[k][j] for k in range(4)) for j in range(4)] for i in range(3)]


def calibrated(points: DataFrame, calib: DataFrame) -> DataFrame:
    """The projection of each point by the cameras of its frame.

    ``calib`` has (frame_id, camera_id, t_lidar and t_cam of 16 numbers by row,
    k of 9, dist of 4, fov as half angle, w, h); the matrix product is made
    once a camera, before the join.
    """
    grid = lambda c: [[F.col(c)[4 * i + j] for j in range(4)] for i in range(4)]
    rows = F.array(*(F.array(*r) for r in lidar_to_camera(grid("t_lidar"), grid("t_cam"))))
    cams = calib.select("frame_id", "camera_id", rows.alias("m"), "k", "dist", "fov", "w", "h")
    col = F.col
    cam = Camera([[col("m")[i][j] for j in range(4)] for i in range(3)], col("k")[0], col("k")[4], col("k")[2], col("k")[5], [col("dist")[i] for i in range(4)], col("fov"), col("w"), col("h"))
    return project(points.join(cams, "frame_id"), cam, col("camera_id"))


def project(points: DataFrame, cam: Camera, camera_id: Column | None = None) -> DataFrame:
    """Points in front of the camera, in its field of view and off the image margin, with half-to-even pixel coordinates."""
    x, y, z = (F.col(c) for c in ("x", "y", "z"))
    moved = F.struct(*((r[0] * x + r[1] * y + r[2] * z + r[3]).alias(n) for r, n in zip(cam.rows, "xyz", strict=True)))

    def then(items: Column, **made) -> Column:
        """Each item with further fields; the lambda variable holds a value that is used many times, which columns would repeat."""
        return F.transform(items, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), *(f(p).alias(n) for n, f in made.items())))

    k = cam.k
    p = F.filter(F.array(moved), lambda p: p["z"] > 0)
    p = then(p, r=lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))
    p = then(p, r=lambda p: p["r"], theta=lambda p: F.atan2(p["r"], p["z"]))
    p = F.filter(p, lambda p: p["theta"] <= cam.half_fov)
    p = then(p, r=lambda p: p["r"], theta=lambda p: p["theta"], t2=lambda p: p["theta"] * p["theta"])
    p = then(p, r=lambda p: p["r"], td=lambda p: p["theta"] * (1 + p["t2"] * (k[0] + p["t2"] * (k[1] + p["t2"] * (k[2] + p["t2"] * k[3])))))
    u = lambda p: F.when(p["r"] > 0, cam.fx * p["td"] * p["x"] / p["r"] + cam.cx).otherwise(F.lit(cam.cx))
    v = lambda p: F.when(p["r"] > 0, cam.fy * p["td"] * p["y"] / p["r"] + cam.cy).otherwise(F.lit(cam.cy))
    p = F.filter(then(p, u=u, v=v), lambda p: (p["u"] >= MARGIN) & (p["u"] < cam.width - MARGIN) & (p["v"] >= MARGIN) & (p["v"] < cam.height - MARGIN))
    one = F.lit(1) if camera_id is None else camera_id
    df = points.select("frame_id", "idx", one.alias("camera_id"), F.inline(p))
    pixel = lambda c: F.least(F.lit(65535), F.greatest(F.lit(0), F.rint(c).cast("int")))
    return df.select("frame_id", "idx", "camera_id", pixel(F.col("u")).alias("px"), pixel(F.col("v")).alias("py"), "x", "y", "z")


def front_share(points: DataFrame) -> DataFrame:
    """Per frame: points, those of the front camera, and whether they are fewer than a tenth."""
    own = F.sum(F.when(F.col("camera_id") == 1, 1).otherwise(0))
    return points.groupBy("frame_id").agg(F.count("*").alias("points"), own.alias("front"), (own < 0.1 * F.count("*")).alias("few"))


def normalised(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """x and y from -50..50 m, z from 0..100 m, to 0..255, cut to whole numbers."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return tuple((unit(v) * 255).cast("int") for v in ((x + 50) / 100, (y + 50) / 100, z / 100))


def enhanced(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Narrower ranges, logarithmic depth and a weight by nearness, which is applied when normalising and again when placing.

    A value is clipped to its range before it is weighted, and to 255 after;
    the second weight may bring it to 765.
    """
    w = F.least(F.lit(3.0), F.greatest(F.lit(0.2), 3 / (z + 1)))
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    fit = lambda v: F.least(F.lit(255.0), unit(v) * 255 * w) * w
    return fit((x + 30) / 60), fit((y + 15) / 30), fit(F.log(z + 1) / F.log(F.lit(121.0)))


def rasterise(projected: DataFrame, width: int = TARGET_W, height: int = TARGET_H, native_w: int = NATIVE_W, native_h: int = NATIVE_H) -> DataFrame:
    """Front-camera points on the target raster; of points on one pixel the one of highest index stays."""
    sx = F.col("px").cast("float") * F.lit(width / native_w).cast("float")
    sy = F.col("py").cast("float") * F.lit(height / native_h).cast("float")
    df = projected.where("camera_id = 1").withColumn("sx", sx).withColumn("sy", sy).where(F.col("sx").between(0, width) & (F.col("sx") < width) & (F.col("sy") >= 0) & (F.col("sy") < height))
    xb, yb, zb = normalised(F.col("x"), F.col("y"), F.col("z"))
    last = df.groupBy("frame_id", F.col("sy").cast("int").alias("y"), F.col("sx").cast("int").alias("x")).agg(F.max_by(F.struct(xb.alias("xb"), yb.alias("yb"), zb.alias("zb")), "idx").alias("b"))
    return last.select("frame_id", "y", "x", "b.*")


def decoded(raster: DataFrame) -> DataFrame:
    """Metres from bytes, for verification."""
    return raster.select("frame_id", "y", "x", (F.col("xb") / 255 * 100 - 50).alias("mx"), (F.col("yb") / 255 * 100 - 50).alias("my"), (F.col("zb") / 255 * 100).alias("mz"))


def resized(h: Column, w: Column, model_side: int = 1024, out_side: int = 768) -> Column:
    """Model and output sizes of an image: its longer side is brought down to ``model_side``, its shorter one to ``out_side``."""
    m = F.when(F.greatest(h, w) > model_side, model_side / F.greatest(h, w)).otherwise(F.lit(1.0))
    o = out_side / F.least(h, w)
    return F.struct((w * m).cast("int").alias("model_w"), (h * m).cast("int").alias("model_h"), (w * o).cast("int").alias("out_w"), (h * o).cast("int").alias("out_h"))


def scaled_box(box: Column, scale: Column) -> Column:
    return F.struct(*((box[c] * scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
