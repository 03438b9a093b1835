"""Scalar rules on frame metadata and labels, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEATHER_NAMES = ("fair", "rain")
#: Both kinds of weather by day and by night, and snow at any time.
CONDITIONS = [*(f"{time}_{weather}" for time in ("day", "night") for weather in WEATHER_NAMES), "snow"]
WET = "drizzle storm hail sleet rain".split()
#: Label ids in order.
LABELS = "background ignore vehicle sign cyclist pedestrian".split()
CLASS_NAMES = dict(enumerate(LABELS))
_SOURCES = {"vehicle": ["Vehicle"], "cyclist": ["VulnerableVehicle"], "pedestrian": ["Pedestrian"], "sign": ["PoleObject", *(f"Traffic{kind}" for kind in ("Guide", "Light", "Sign", "Signal"))]}
SOURCE_CLASSES = {source: LABELS.index(label) for label, sources in _SOURCES.items() for source in sources}


def weather_bucket(weather: Column) -> Column:
    """snow wins over any kind of rain; everything else, null too, is fair."""
    w = F.lower(F.coalesce(weather, F.lit("")))
    wet = w.contains(WET[0])
    for kind in WET[1:]:
        wet = wet | w.contains(kind)
    return F.when(w.contains("snow"), "snow").when(wet, "rain").otherwise("fair")


def time_bucket(time_of_day: Column) -> Column:
    """night if the word occurs, else day: twilight and null are day."""
    return F.when(F.lower(F.coalesce(time_of_day, F.lit("day"))).contains("night"), "night").otherwise("day")


def condition(weather: Column, time_of_day: Column, has_metadata: Column | None = None) -> Column:
    """One of CONDITIONS; snow at any time of day is snow; null without metadata."""
    bucket = weather_bucket(weather)
    name = F.when(bucket == "snow", F.lit("snow")).otherwise(F.concat_ws("_", time_bucket(time_of_day), bucket))
    known = F.when(name.isin(CONDITIONS), name)
    return known if has_metadata is None else F.when(has_metadata, known)


def frame_id_of_path(path: Column) -> Column:
    """Last path segment without every ``frame_`` and ``.png``."""
    last = F.element_at(F.split(F.trim(path), "/"), -1)
    return F.replace(F.replace(last, F.lit("frame_"), F.lit("")), F.lit(".png"), F.lit(""))


def frame_path(frame_id: Column) -> Column:
    return F.concat(F.lit("camera/frame_"), frame_id, F.lit(".png"))


def title(key: Column) -> Column:
    """``day_rain+wet_road`` as ``Day Rain + Wet Road``."""
    return F.initcap(F.replace(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("+"), F.lit(" + ")))


def digits(text: Column) -> Column:
    """The integer of an all-digit string, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def map_get(m: Column, key: Column, default: object) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def transition_ends(key: Column) -> tuple[Column, Column]:
    """Both ends of ``from->to``; null without an arrow."""
    has = key.contains("->")
    return F.when(has, F.split_part(key, F.lit("->"), F.lit(1))), F.when(has, F.split_part(key, F.lit("->"), F.lit(2)))


def human_size(n: Column) -> Column:
    mb, kb = n / F.lit(1024.0 * 1024), n / F.lit(1024.0)
    return F.when(n >= 1024 * 1024, F.format_string("%.1f MB", mb)).when(n >= 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%d bytes", n))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def class_of(name: Column) -> Column:
    """Label id of a source class name; null if it has none."""
    pairs = [F.lit(x) for kv in SOURCE_CLASSES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), name)


def class_name(class_id: Column) -> Column:
    pairs = [F.lit(x) for kv in CLASS_NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), class_id)


def time_and_weather(name: Column) -> tuple[Column, Column]:
    """The parts of a name such as night_rain."""
    return F.split_part(name, F.lit("_"), F.lit(1)), F.split_part(name, F.lit("_"), F.lit(2))
