"""Every query of the curation engine, over the relations of rastrum.plans.bridge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.functions import conditions as c
from rastrum.operators import boxes, curation, geometry, predictor, raster, raster_np, reports
from rastrum.operators import frames as fr
from rastrum.plans import bridge
from rastrum.plans.bridge import GRID_H, GRID_W, IMG_H, IMG_W
from rastrum.plans.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The camera of the point queries: 640 x 480, axes swapped from LiDAR to camera by identity rows.
CAMERA = geometry.Camera(geometry.lidar_to_camera([[1, 0, 0, 0.5], [0, 1, 0, -0.25], [0, 0, 1, 0], [0, 0, 0, 1]], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1.0], [0, 0, 0, 1]]), 300.0, 300.0, 320.0, 240.0, (0.05, -0.01, 0.002, -0.0005), 1.2, 640, 480)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- relations


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    f = bridge.frames(spark, sf)
    return f.withColumn("condition", c.condition(F.col("scraped_weather"), F.col("time_of_day"), F.col("has_metadata")))


def _weather(spark: SparkSession, sf: str) -> DataFrame:
    w = F.lower(F.coalesce("scraped_weather", F.lit("clear")))
    weather = F.when(w.contains("snow"), "snow").when(w.contains("rain") | w.contains("drizzle") | w.contains("storm"), "rain").otherwise(w)
    return bridge.frames(spark, sf).select("frame_id", "ord", "region", weather.alias("weather"), F.lower(F.coalesce("time_of_day", F.lit("day"))).alias("time"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.usable_boxes(bridge.objects(spark, sf), IMG_W, IMG_H)


def _kept(spark: SparkSession, sf: str, cap: int = boxes.CAP) -> DataFrame:
    return boxes.capped_boxes(boxes.merged_boxes(_boxes(spark, sf)), cap)


def _masks(usable: DataFrame, kernel: Callable[[pa.Array, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    return boxes.masks(boxes.merged_boxes(usable), IMG_W, IMG_H, GRID_W, GRID_H, kernel, schema)


def _grid(usable: DataFrame) -> DataFrame:
    return raster_np.cells_of(_masks(usable, raster_np.sparse, raster_np.SPARSE))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(_boxes(spark, sf))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return _masks(_boxes(spark, sf), curation.raster_classes, curation.CLASSES)


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    return curation.histogram(_classes(spark, sf), GRID_W * GRID_H)


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    per = curation.frame_records(_classes(spark, sf))
    return _frames(spark, sf).select("frame_id", "ord", "condition").join(per, "frame_id")


def _split(spark: SparkSession, sf: str, *carry: str) -> DataFrame:
    return curation.stratified_split(_stats(spark, sf), carry=carry)


def _raster(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.rasterise(geometry.project(bridge.points(spark, sf), CAMERA), GRID_W, GRID_H, CAMERA.width, CAMERA.height)


# ---- conditions and curation


@query
def frame_condition(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    return f.select("frame_id", c.weather_bucket(F.col("scraped_weather")).alias("weather"), c.time_bucket(F.col("time_of_day")).alias("time"), "condition")


@query
def condition_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return curation.condition_distribution(_frames(spark, sf))


@query
def frame_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    return fr.parsed_ids(bridge.paths(spark, sf))


@query
def frame_class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _hist(spark, sf).select("frame_id", "class_id", "n", F.round("pct", 6).alias("pct"))


@query
def frame_object_stats(spark: SparkSession, sf: str) -> DataFrame:
    return curation.frame_records(_classes(spark, sf)).select("frame_id", "total_pixels", "object_pixels", "num_classes")


@query
def dominant_class(spark: SparkSession, sf: str) -> DataFrame:
    return curation.frame_records(_classes(spark, sf)).select("frame_id", F.col("dominant").alias("class_id"), c.class_name(F.col("dominant")).alias("class_name"))


@query
def viz_top2_per_condition(spark: SparkSession, sf: str) -> DataFrame:
    return curation.top_frames(_stats(spark, sf)).select("condition", "frame_id", "object_pixels", F.col("place").cast("bigint").alias("place"))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("frame_id", "condition", "dominant", "split")


@query
def document_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same split on documents: language as condition, quality as class."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return curation.stratified_split(d.join(lab, "doc_id"), "doc_id", ("lang", "quality")).select("doc_id", "lang", "quality", "split")


@query
def split_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    return curation.split_by_condition(_split(spark, sf))


@query
def split_class_representation(spark: SparkSession, sf: str) -> DataFrame:
    return curation.class_representation(_split(spark, sf, "classes"))


@query
def split_class_detail(spark: SparkSession, sf: str) -> DataFrame:
    return curation.split_detail(_split(spark, sf, "classes"))


@query
def condition_pixel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return curation.condition_pixels(_hist(spark, sf), _frames(spark, sf))


# ---- boxes and masks


@query
def box_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf)


@query
def frame_status(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.frame_status(bridge.objects(spark, sf), _boxes(spark, sf))


@query
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return fr.run_counters(boxes.frame_status(bridge.objects(spark, sf), _boxes(spark, sf)))


@query
def box_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.merged_boxes(_boxes(spark, sf)).select("frame_id", "class_id", "x0", "y0", "x1", "y1", "area")


@query
def box_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The cap at 2 boxes a frame: 75 binds nowhere in these tables."""
    return _kept(spark, sf, 2).select("frame_id", "class_id", "x0", "y0", "x1", "y1", "area", F.col("place").cast("bigint").alias("place"))


@query
def mask_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("frame_id", "y", "x", "class_id", c.class_name(F.col("class_id")).alias("class_name"))


@query
def prompt_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Masks through the predictor interface; each box is scaled to the grid and filled."""
    g = _kept(spark, sf).selectExpr(
        "frame_id",
        "class_id",
        f"CAST(floor(x0 * {GRID_W} / {IMG_W}) AS INT) AS x0",
        f"CAST(floor(y0 * {GRID_H} / {IMG_H}) AS INT) AS y0",
        f"CAST(floor((x1 - 1) * {GRID_W} / {IMG_W}) AS INT) + 1 AS x1",
        f"CAST(floor((y1 - 1) * {GRID_H} / {IMG_H}) AS INT) + 1 AS y1",
    )
    return predictor.cells_of(predictor.composite_masks(g, GRID_H, GRID_W))


@query
def camera_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame with a usable box has cells, so that the strips need no second fold."""
    return raster_np.cells_of(_masks(_boxes(spark, sf), lambda ids, a: raster_np.sparse(ids, raster.ignored_edges(a)), raster_np.SPARSE))


# ---- frames


@query
def available_frames(spark: SparkSession, sf: str) -> DataFrame:
    return fr.available(bridge.frames(spark, sf), bridge.objects(spark, sf))


@query
def resume_frames(spark: SparkSession, sf: str) -> DataFrame:
    return fr.remaining(bridge.frames(spark, sf).select("frame_id"), _boxes(spark, sf))


@query
def sweep_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    s = bridge.read(spark, sf, "events", "SELECT lpad(CAST(event_id AS STRING), 9, '0') AS frame_id, user_id AS sensor, ts, event_type = 'view' AS is_keyframe FROM events")
    return fr.sweep_neighbours(s)


# ---- points


@query
def project_points(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.project(bridge.points(spark, sf), CAMERA).select("frame_id", "idx", "camera_id", "px", "py", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query
def lidar_raster(spark: SparkSession, sf: str) -> DataFrame:
    return _raster(spark, sf)


@query
def lidar_density(spark: SparkSession, sf: str) -> DataFrame:
    return raster.density(_raster(spark, sf)).select("frame_id", "y", "x", F.col("cnt").cast("bigint").alias("cnt"))


@query
def lidar_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Only the objects of frames with points are folded and spread over cells."""
    seen = bridge.read(spark, sf, "embeddings", "SELECT DISTINCT lpad(CAST(label AS STRING), 9, '0') AS frame_id FROM embeddings")
    own = boxes.usable_boxes(bridge.objects(spark, sf).join(seen, "frame_id", "left_semi"), IMG_W, IMG_H)
    return raster.lidar_labels(_raster(spark, sf), _grid(own), GRID_H)


@query
def raster_qa(spark: SparkSession, sf: str) -> DataFrame:
    return raster.raster_qa(_raster(spark, sf), GRID_W * GRID_H)


@query
def enhanced_points(spark: SparkSession, sf: str) -> DataFrame:
    p = geometry.project(bridge.points(spark, sf), CAMERA)
    x, y, z = geometry.enhanced(F.col("x"), F.col("y"), F.col("z"))
    return p.select("frame_id", "idx", F.round(x, 4).alias("xe"), F.round(y, 4).alias("ye"), F.round(z, 4).alias("ze"))


@query
def enhanced_raster(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted placement, blur, gap filling, dilation and scaling of every frame; filled cells and channel sums."""
    p = geometry.project(bridge.points(spark, sf), CAMERA)
    x, y, z = geometry.enhanced(F.col("x"), F.col("y"), F.col("z"))
    sx, sy = F.col("px") * (GRID_W / CAMERA.width), F.col("py") * (GRID_H / CAMERA.height)
    placed = p.select("frame_id", "idx", sy.cast("int").alias("y"), sx.cast("int").alias("x"), F.struct(x.alias("xe"), y.alias("ye"), z.alias("ze")).alias("b"))
    cells = placed.groupBy("frame_id", "y", "x").agg(F.max_by("b", "idx").alias("b")).select("frame_id", "y", "x", "b.*")
    out = raster_np.per_frame(raster_np.dense(cells, GRID_H, GRID_W, ["xe", "ye", "ze"], np.float32), raster_np.enhanced, dtype=np.float32)
    return out.select("frame_id", "h", "w", "status", F.md5("data").alias("digest"))


@query
def mask_components(spark: SparkSession, sf: str) -> DataFrame:
    """The 8-connected regions of each class of every mask, with their areas."""
    return _masks(_boxes(spark, sf), raster_np.component_areas, raster_np.AREAS)


@query
def mask_resized(spark: SparkSession, sf: str) -> DataFrame:
    """Class histogram of every mask resampled to twice its size by nearest neighbour."""
    big = lambda a: raster_np.nearest(a.transpose(1, 2, 0), 2 * GRID_H, 2 * GRID_W).transpose(2, 0, 1)
    return _masks(_boxes(spark, sf), lambda ids, a: raster_np.class_areas(ids, big(a)), raster_np.CLASS_AREAS)


# ---- reports


@query
def weather_share(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distribution(_weather(spark, sf), "weather")


@query
def time_weather_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return reports.crosstab(_weather(spark, sf))


@query
def challenging_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return reports.challenging_by_time(_weather(spark, sf))


@query
def severity_split(spark: SparkSession, sf: str) -> DataFrame:
    return reports.severity(_weather(spark, sf))


@query
def weather_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ratios(_weather(spark, sf))


@query
def challenging_flags(spark: SparkSession, sf: str) -> DataFrame:
    return reports.challenging(_weather(spark, sf)).select("flags", "n", "pct", "high_risk", c.title(F.col("flags")).alias("title"))


@query
def high_risk(spark: SparkSession, sf: str) -> DataFrame:
    return reports.challenging(_weather(spark, sf)).where("high_risk").select("flags", "n", "pct")


@query
def weather_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transitions(_weather(spark, sf))


@query
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transition_matrix(reports.transitions(_weather(spark, sf)))


@query
def weather_stability(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stability(reports.transitions(_weather(spark, sf)))


@query
def region_top_weather(spark: SparkSession, sf: str) -> DataFrame:
    return reports.region_top_weather(_weather(spark, sf))


@query
def weather_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return fr.arg_extremes(_weather(spark, sf).groupBy("weather").agg(F.count("*").alias("n")), "weather", "n", "weather")


@query
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the ten commonest classes."""
    return reports.top_values(bridge.objects(spark, sf), "name")


@query
def class_type_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.class_type_rollup(bridge.objects(spark, sf))


@query
def focus_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return reports.focus_per_frame(bridge.objects(spark, sf))


@query
def size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.size_stats(bridge.objects(spark, sf))


@query
def occlusion_share(spark: SparkSession, sf: str) -> DataFrame:
    return reports.occlusion_share(bridge.objects(spark, sf))


@query
def position_share(spark: SparkSession, sf: str) -> DataFrame:
    return reports.position_share(bridge.objects(spark, sf))


@query
def ego_lane(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ego_lane(bridge.objects(spark, sf))


@query
def objects_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.objects_histogram(bridge.objects(spark, sf))


@query
def traffic_density(spark: SparkSession, sf: str) -> DataFrame:
    return reports.traffic_density(reports.objects_histogram(bridge.objects(spark, sf)))


@query
def scene_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return reports.scene_complexity(bridge.objects(spark, sf))


@query
def objects_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return reports.objects_per_frame(reports.objects_histogram(bridge.objects(spark, sf)))
