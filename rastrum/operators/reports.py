"""Distribution, crosstab, transition and density reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEATHERS = ["clear", "cloudy", "fog", "rain", "snow", "windy"]
TIMES = ["day", "night", "twilight"]
CHALLENGING = ["rain", "snow", "fog"]
BENIGN = ["clear", "cloudy"]
FOCUS = {"cyclists": ("type", ["Bicycle"]), "pedestrians": ("name", ["Pedestrian"]), "signs": ("name", ["TrafficSign", "TrafficSignal"]), "vehicles": ("name", ["Vehicle"])}
EGO = ["EgoLane", "LeftAndEgoLane", "RightAndEgoLane"]


def _share(part: str | Column, over: object) -> Column:
    p = F.col(part) if isinstance(part, str) else part
    return F.round(p / F.sum(p).over(over) * 100, 6)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value of ``key`` and their share of all."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("pct"))


def top_values(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def crosstab(df: DataFrame, row: str = "time", col: str = "weather", values: list[str] = WEATHERS) -> DataFrame:
    return df.groupBy(row).pivot(col, values).count().na.fill(0, values)


def challenging_by_time(df: DataFrame) -> DataFrame:
    """Each challenging weather: its frames by time, and their share within the weather."""
    n = df.where(F.col("weather").isin(CHALLENGING)).groupBy("weather", "time").agg(F.count("*").alias("n"))
    return n.select("weather", "time", "n", F.sum("n").over(W.partitionBy("weather")).alias("total"), _share("n", W.partitionBy("weather")).alias("pct"))


def severity(df: DataFrame) -> DataFrame:
    """benign, challenging and other weather."""
    kind = F.when(F.col("weather").isin(BENIGN), "benign").when(F.col("weather").isin(CHALLENGING), "challenging").otherwise("other")
    return distribution(df.select(kind.alias("severity")), "severity")


def ratios(df: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, w = F.col("time"), F.col("weather")
    day, night, clear, rain = n(t == "day"), n(t == "night"), n(w == "clear"), n(w == "rain")
    div = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return df.agg(day.alias("day"), night.alias("night"), clear.alias("clear"), rain.alias("rain"), div(day, night).alias("day_night"), div(clear, rain).alias("clear_rain"))


def flags(time: Column, weather: Column) -> Column:
    """The challenging flags of a frame, joined by +, or normal."""
    night = time == "night"
    f = F.concat_ws(
        "+",
        F.when(weather == "rain", "wet_road"),
        F.when(weather == "fog", "low_visibility"),
        F.when(weather == "snow", "winter_driving"),
        F.when(night, "night_driving"),
        F.when(night & weather.isin(CHALLENGING), "night_adverse_weather"),
    )
    return F.when(f == "", "normal").otherwise(f)


def challenging(df: DataFrame) -> DataFrame:
    """Frames by flags, with share, and whether at high risk: at night in adverse weather, or in winter."""
    d = distribution(df.select(flags(F.col("time"), F.col("weather")).alias("flags")), "flags")
    return d.withColumn("high_risk", F.col("flags").contains("night_adverse_weather") | F.col("flags").contains("winter_driving"))


def transitions(df: DataFrame, order: str = "ord", bucket: int = 100_000) -> DataFrame:
    """Counts of (weather before, weather) over consecutive frames.

    Consecutive frames meet within buckets of the order; the last frame of a
    bucket is handed on to the next one, so that no global sort is needed.
    """
    d = df.select(F.col(order).alias("o"), "weather", F.expr(f"CAST(floor({order} / {bucket}) AS BIGINT)").alias("k"))
    ends = d.groupBy("k").agg(F.max_by("weather", "o").alias("weather"), F.max("o").alias("o"))
    # one row a bucket: the next bucket that has any
    handed = ends.withColumn("k2", F.lead("k").over(W.orderBy("k"))).where("k2 IS NOT NULL").select(F.col("o"), "weather", F.col("k2").alias("k"), F.lit(True).alias("before"))
    w = W.partitionBy("k").orderBy("o")
    both = d.withColumn("before", F.lit(False)).unionByName(handed)
    pairs = both.select("before", F.col("weather").alias("to_weather"), F.lag("weather").over(w).alias("from_weather"), F.row_number().over(w).alias("r")).where("NOT before AND r > 1")
    return pairs.groupBy("from_weather", "to_weather").agg(F.count("*").alias("n"))


def transition_matrix(pairs: DataFrame, values: list[str] = WEATHERS) -> DataFrame:
    return pairs.groupBy("from_weather").pivot("to_weather", values).sum("n").na.fill(0, values)


def stability(pairs: DataFrame) -> DataFrame:
    """How often a weather stays, of all times it is left or stays."""
    w = W.partitionBy("from_weather")
    return pairs.withColumn("pct", _share("n", w)).where("from_weather = to_weather").select(F.col("from_weather").alias("weather"), "n", "pct")


def region_top_weather(df: DataFrame) -> DataFrame:
    """The commonest weather of each region (ties: alphabetically first) and its share."""
    n = df.groupBy("region", "weather").agg(F.count("*").alias("n"))
    return n.groupBy("region").agg(F.min_by("weather", F.struct(-F.col("n"), "weather")).alias("weather"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n") * 100, 6).alias("pct"))


def class_type_rollup(objects: DataFrame) -> DataFrame:
    """Objects by class, by type and by both, and their share of all objects; each of the three sets adds up to all."""
    g = objects.groupingSets([["name"], ["type"], ["name", "type"]], "name", "type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy()) / 3  # over one row a class and type
    return g.select(F.coalesce("name", F.lit("(all)")).alias("name"), F.coalesce("type", F.lit("(all)")).alias("type"), "n", F.round(F.col("n") / total * 100, 6).alias("pct"))


def _focus(objects: DataFrame) -> DataFrame:
    arms = [F.when(F.col(c).isin(v), F.lit(k)) for k, (c, v) in FOCUS.items()]
    return objects.withColumn("category", F.explode(F.array_compact(F.array(*arms))))


def focus_per_frame(objects: DataFrame) -> DataFrame:
    """Per category that occurs: objects, frames with any, the most and the mean of those frames, and the share of all objects."""
    per = objects.groupBy("frame_id").agg(F.count("*").alias("objects"), *(F.count_if(F.col(c).isin(v)).alias(k) for k, (c, v) in FOCUS.items()))
    whole = per.agg(F.sum("objects").alias("objects"), *(F.struct(F.sum(k).alias("total"), F.count_if(F.col(k) > 0).alias("frames"), F.max(k).alias("most")).alias(k) for k in FOCUS))
    rows = whole.select("objects", F.inline(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k)["total"].alias("total"), F.col(k)["frames"].alias("frames"), F.col(k)["most"].alias("most")) for k in FOCUS)))).where("total > 0")
    return rows.select("category", "total", "frames", "most", F.round(F.col("total") / F.col("frames"), 6).alias("mean"), F.round(F.col("total") / F.col("objects") * 100, 6).alias("pct"))


def size_stats(objects: DataFrame) -> DataFrame:
    """Per category and dimension: count, mean, median, sample deviation and range."""
    long = _focus(objects).select("category", F.expr("stack(3, 'length', length, 'width', width, 'height', height) AS (dimension, v)")).where("v IS NOT NULL")
    r = lambda c: F.round(c, 6)
    return long.groupBy("category", "dimension").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.percentile("v", F.lit(0.5))).alias("median"), r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("least"), r(F.max("v")).alias("most"))


def occlusion_share(objects: DataFrame) -> DataFrame:
    n = _focus(objects).groupBy("category", "occlusion").agg(F.count("*").alias("n"))
    return n.withColumn("pct", _share("n", W.partitionBy("category")))


def position_share(objects: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest positions of each category; unknown ones count in the share but are no rows."""
    n = _focus(objects).groupBy("category", "relative_position").agg(F.count("*").alias("n")).withColumn("pct", _share("n", W.partitionBy("category")))
    ranked = n.where("relative_position <> 'unknown'").withColumn("place", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "relative_position")))
    return ranked.where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def ego_lane(objects: DataFrame) -> DataFrame:
    p = F.col("relative_position")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return _focus(objects).groupBy("category").agg(n(p.isin(EGO))("ego_lane"), n((p != "OffRoad") & (p != "unknown"))("on_road"), n(p == "OffRoad")("off_road"))


def objects_histogram(objects: DataFrame) -> DataFrame:
    """Frames by their number of objects."""
    return objects.groupBy("frame_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n_frames"))


def traffic_density(hist: DataFrame) -> DataFrame:
    k, n = F.col("k"), F.col("n_frames")
    s = lambda c: F.sum(F.when(c, n).otherwise(0)).alias
    return hist.agg(s(k < 5)("low"), s((k >= 5) & (k <= 15))("medium"), s(k > 15)("high"), s(k > 50)("very_high"))


def scene_complexity(objects: DataFrame) -> DataFrame:
    """Frames of fewer than 3, of 3 to 6 and of more than 6 classes of objects, and their share."""
    per = objects.groupBy("frame_id").agg(F.count_distinct("name").alias("k"))
    kind = F.when(F.col("k") < 3, "simple").when(F.col("k") <= 6, "moderate").otherwise("complex")
    return distribution(per.select(kind.alias("complexity")), "complexity")


def map_rows(report: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row an entry of a map, as the JSON reports have them; a null or empty map has none."""
    return report.select(F.explode(column).alias(key, value))


def objects_per_frame(hist: DataFrame) -> DataFrame:
    """Weighted mean, range and sample deviation of objects a frame, from the histogram."""
    k, n = F.col("k"), F.col("n_frames")
    a = hist.agg(F.sum(n).alias("frames"), F.sum(k * n).alias("objects"), F.sum(k * k * n).alias("squares"), F.min("k").alias("least"), F.max("k").alias("most"))
    var = (F.col("squares") - F.col("objects") * F.col("objects") / F.col("frames")) / (F.col("frames") - 1)
    return a.select("frames", "objects", F.round(F.col("objects") / F.col("frames"), 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"), "least", "most")
