"""Class statistics of label rasters, representative frames and stratified splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrum.functions.conditions import CLASS_NAMES, CONDITIONS, class_name, percent
from rastrum.operators import raster_np

SEED = "42"


def frame_classes(cells: DataFrame, total_cells: int) -> DataFrame:
    """(frame_id, classes): the (class_id, n) of each frame's sparse label cells; class 0 fills the rest of the raster."""
    seen = cells.groupBy("frame_id", "class_id").agg(F.count("*").alias("n"))
    # the rest is added to the frame's own list, so that cells are made and counted once
    per = seen.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("class_id", "n"))).alias("l"), (F.lit(total_cells).cast("bigint") - F.sum("n")).alias("rest"))
    whole = F.when(F.col("rest") > 0, F.array_append("l", F.struct(F.lit(0).alias("class_id"), F.col("rest").alias("n")))).otherwise(F.col("l"))
    return per.select("frame_id", whole.alias("classes"))


CLASSES = "frame_id string, classes array<struct<class_id: int, n: bigint>>"


def raster_classes(ids: pa.Array, rasters: np.ndarray) -> pa.RecordBatch:
    """The lists of ``frame_classes``, of label rasters."""
    classes, n = raster_np.class_counts(rasters)
    # as in frame_classes, class 0 comes last
    n = np.concatenate([n, rasters[0].size - n.sum(axis=1, keepdims=True)], axis=1).astype(np.int64)
    frame, at = np.nonzero(n)
    first = np.searchsorted(frame, np.arange(len(ids) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(np.append(classes, 0)[at].astype(np.int32)), pa.array(n[frame, at])], names=["class_id", "n"])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(first), items)], names=["frame_id", "classes"])


def histogram(per: DataFrame, total_cells: int) -> DataFrame:
    """(frame_id, class_id, n, pct) of each frame's list of classes."""
    return per.select("frame_id", F.inline("classes")).withColumn("pct", percent(F.col("n"), F.lit(total_cells)))


def class_histogram(cells: DataFrame, total_cells: int) -> DataFrame:
    """(frame_id, class_id, n, pct) of sparse label cells."""
    return histogram(frame_classes(cells, total_cells), total_cells)


def frame_records(per: DataFrame) -> DataFrame:
    """The columns of frame_stats and the list itself, from each frame's list of classes: no further grouping."""
    c = F.col("classes")
    best = F.array_max(F.transform(c, lambda x: F.struct(x["n"].alias("n"), (-x["class_id"]).alias("k"))))
    summed = lambda keep: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.when(keep(x), x["n"]).otherwise(F.lit(0).cast("bigint")))
    return per.select("frame_id", summed(lambda x: F.lit(True)).alias("total_pixels"), summed(lambda x: x["class_id"] > 0).alias("object_pixels"), F.size(c).cast("bigint").alias("num_classes"), (-best["k"]).alias("dominant"), "classes")


def frame_stats(hist: DataFrame) -> DataFrame:
    """Per frame: pixels, object pixels (every class above 0, ignore too), classes present, and the dominant class (ties: the lowest)."""
    best = F.max_by("class_id", F.struct("n", -F.col("class_id")))
    return hist.groupBy("frame_id").agg(F.sum("n").alias("total_pixels"), F.sum(F.when(F.col("class_id") > 0, F.col("n")).otherwise(0)).alias("object_pixels"), F.count("*").alias("num_classes"), best.alias("dominant"))


def analysis_records(frames: DataFrame, hist: DataFrame, stats: DataFrame) -> DataFrame:
    """One struct a frame, as the JSON report has it; of rows with one id the last by ``ord`` stays."""
    maps = hist.groupBy("frame_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("class_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "pct")))).alias("class_percentages"),
        F.array_sort(F.collect_list("class_id")).alias("classes_present"),
    )
    last = frames.groupBy("frame_id").agg(F.max_by("condition", "ord").alias("condition"))
    return last.join(stats, "frame_id").join(maps, "frame_id")


def top_frames(frames: DataFrame, k: int = 2) -> DataFrame:
    """The k frames of most object pixels in each condition; ties in input order."""
    return frames.where("condition IS NOT NULL").selectExpr("*", "row_number() OVER (PARTITION BY condition ORDER BY object_pixels DESC, ord) AS place").where(F.col("place") <= k)


def stratified_split(frames: DataFrame, key: str = "frame_id", strata: tuple[str, ...] = ("condition", "dominant"), seed: str = SEED, carry: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """(key, strata, carry, split): half train, a quarter val, the rest test in every stratum, in the order of a seeded hash; no stratum of null condition.

    A stratum may hold any share of the rows, so it is ranked in pieces of the
    first hex digits of the hash; a piece starts at the number of rows before
    it.  Those starts, 16^digits a stratum at most, are broadcast: strata must
    be few, as conditions and classes are.  Both uses of the ranks read one
    exchange.  Rows of one key are ordered by what they carry.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    rows = frames.where(F.col(strata[0]).isNotNull()).select(key, *strata, *carry, h.alias("h__")).withColumn("p__", F.substring("h__", 1, digits))
    piece = W.partitionBy(*strata, "p__")
    ranked = rows.withColumn("r__", F.row_number().over(piece.orderBy("h__", key, *carry))).withColumn("n__", F.count("*").over(piece))
    sizes = ranked.where("r__ = 1").select(*(F.col(c).alias(f"{c}__") for c in strata), F.col("p__").alias("q__"), F.col("n__").alias("m__"))
    stratum = W.partitionBy(*(f"{c}__" for c in strata))
    before = F.sum("m__").over(stratum.orderBy("q__").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("*", F.coalesce(before, F.lit(0)).alias("before__"), F.sum("m__").over(stratum).alias("stratum__"))
    same = F.col("p__").eqNullSafe(F.col("q__"))  # an equality would add a filter below one of the two uses
    for c in strata:
        same &= F.col(c).eqNullSafe(F.col(f"{c}__"))
    place = F.col("before__") + F.col("r__")
    train, val = F.floor(F.col("stratum__") * 0.5), F.floor(F.col("stratum__") * 0.25)
    split = F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")
    return ranked.join(F.broadcast(starts), same).select(key, *strata, *carry, split.alias("split"))


def condition_distribution(frames: DataFrame) -> DataFrame:
    """Frames of each of the five conditions; shares are of all frames, those without condition too."""
    spark = frames.sparkSession
    all_ = spark.createDataFrame([(c,) for c in CONDITIONS], "condition string")
    counted = frames.groupBy("condition").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    joined = F.broadcast(all_).join(counted, "condition", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return joined.select("condition", n.alias("n_frames"), F.round(percent(n, F.col("total")), 6).alias("pct"))


def split_by_condition(split: DataFrame) -> DataFrame:
    names = ["train", "val", "test"]
    p = split.groupBy("condition").pivot("split", names).count().na.fill(0, names)
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return p.select("condition", *names, *(F.round(percent(F.col(c), total), 6).alias(f"{c}_pct") for c in names))


def condition_pixels(hist: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels of each class in each condition, and their share of the condition's pixels."""
    by = hist.join(frames.select("frame_id", "condition").where("condition IS NOT NULL"), "frame_id").groupBy("condition", "class_id").agg(F.sum("n").alias("pixels"))
    share = by.selectExpr("*", "sum(pixels) OVER (PARTITION BY condition) AS whole")
    return share.select("condition", "class_id", class_name(F.col("class_id")).alias("class_name"), "pixels", F.round(percent(F.col("pixels"), F.col("whole")), 6).alias("pct"))


def _marked(split: DataFrame) -> DataFrame:
    """(split, condition, class_id, n) of every class of every frame, and a class -1 that counts the frame itself."""
    frame = F.struct(F.lit(-1).alias("class_id"), F.lit(0).cast("bigint").alias("n"))
    return split.select("split", "condition", F.inline(F.array_append("classes", frame)))


def class_representation(split: DataFrame) -> DataFrame:
    """For each split and each of the six classes: frames with it and pixels, with shares; absent classes are 0.

    ``split`` carries the list of classes, so that boxes are folded once.
    """
    rows = _marked(split).groupBy("split", "class_id").agg(F.count("*").alias("frames"), F.sum("n").alias("pixels"))
    per = rows.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("class_id", F.struct("frames", "pixels")))).alias("of"), F.max(F.when(F.col("class_id") == -1, F.col("frames"))).alias("whole"), F.sum("pixels").alias("all"))
    classes = F.array(*(F.struct(F.lit(k).alias("class_id"), F.lit(v).alias("class_name")) for k, v in CLASS_NAMES.items()))
    grid = per.select("*", F.inline(classes))
    of = F.try_element_at("of", F.col("class_id"))
    grid = grid.select("split", "class_id", "class_name", "whole", "all", F.coalesce(of["frames"], F.lit(0)).alias("frames"), F.coalesce(of["pixels"], F.lit(0)).alias("pixels"))
    return grid.select("split", "class_id", "class_name", "frames", F.round(percent(F.col("frames"), F.col("whole")), 6).alias("frames_pct"), "pixels", F.round(percent(F.col("pixels"), F.col("all")), 6).alias("pixels_pct"))


def split_detail(split: DataFrame) -> DataFrame:
    """Frames and pixels by split and class, and the same for each condition of the test split, with shares, in one pass of grouping sets."""
    g = _marked(split).groupingSets([["split", "class_id"], ["split", "condition", "class_id"]], "split", "condition", "class_id").agg(F.sum("n").alias("pixels"), F.count("*").alias("frames"), F.grouping("condition").alias("g"))
    rows = g.where("g = 1 OR split = 'test'").select("split", F.when(F.col("g") == 1, "(all)").otherwise(F.col("condition")).alias("condition"), "class_id", "frames", "pixels")
    own = W.partitionBy("split", "condition")  # a few rows each by now
    shares = rows.select("*", F.max(F.when(F.col("class_id") == -1, F.col("frames"))).over(own).alias("whole"), F.sum("pixels").over(own).alias("all")).where("class_id >= 0")
    return shares.select("split", "condition", "class_id", "frames", F.round(percent(F.col("frames"), F.col("whole")), 6).alias("frames_pct"), "pixels", F.round(percent(F.col("pixels"), F.col("all")), 6).alias("pixels_pct"))
