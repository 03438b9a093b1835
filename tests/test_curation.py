"""Boundary rules of conditions, splits, reports and frame sets."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rastrum.functions import conditions as c
from rastrum.operators import curation, reports
from rastrum.operators import frames as fr


@pytest.mark.parametrize(
    ("weather", "time", "has", "want"),
    [
        ("snow-rain", "day", True, "snow"),
        ("snow", "Night", True, "snow"),
        ("Thunderstorm", "day", True, "day_rain"),
        (None, "twilight", True, "day_fair"),
        ("fog", "Night", True, "night_fair"),
        ("drizzle", None, True, "day_rain"),
        ("clear", "day", False, None),
    ],
)
def test_condition(spark, weather, time, has, want):
    df = spark.createDataFrame([(weather, time, has)], "w string, t string, h boolean")
    assert df.select(c.condition(F.col("w"), F.col("t"), F.col("h"))).first()[0] == want


def test_ids(spark):
    df = spark.createDataFrame([(0, "camera/frame_099985.png"), (1, "frame_000001"), (2, "  "), (3, "  a/b/7 ")], "ord long, line string")
    assert [tuple(r)[1:] for r in fr.parsed_ids(df).orderBy("ord").collect()] == [("099985", "camera/frame_099985.png"), ("000001", "camera/frame_000001.png"), ("7", "camera/frame_7.png")]


def test_scalars(spark):
    df = spark.createDataFrame([("day_rain+wet_road", "12", "a->b", {"x": 1}), ("fog", "1.5", "ab", {"y": 2})], "k string, d string, t string, m map<string, int>")
    a, b = c.transition_ends(F.col("t"))
    rows = df.select(c.title(F.col("k")), c.digits(F.col("d")), a, b, c.map_get(F.col("m"), F.lit("x"), 0)).collect()
    assert [tuple(r) for r in rows] == [("Day Rain + Wet Road", 12, "a", "b", 1), ("Fog", None, None, None, 0)]
    sizes = spark.createDataFrame([(512,), (2048,), (3 << 20,)], "n long").select(c.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["512 bytes", "2.0 KB", "3.0 MB"]


def test_frame_stats(spark):
    cells = spark.createDataFrame([("a", 0, i, 1) for i in range(5)] + [("a", 1, i, 2) for i in range(3)] + [("b", 0, 0, 2)], "frame_id string, y int, x int, class_id int")
    hist = curation.class_histogram(cells, 16)
    s = {r["frame_id"]: r for r in curation.frame_stats(hist).collect()}
    assert (s["a"]["object_pixels"], s["a"]["dominant"], s["a"]["num_classes"], s["a"]["total_pixels"]) == (8, 0, 3, 16)
    tie = curation.frame_stats(curation.class_histogram(cells.where("frame_id = 'b'"), 2)).first()
    assert tie["dominant"] == 0  # one cell each: the lowest class
    rec = curation.analysis_records(spark.createDataFrame([("a", "snow", 0), ("a", "day_fair", 1)], "frame_id string, condition string, ord long"), hist, curation.frame_stats(hist)).first()
    assert rec["condition"] == "day_fair" and rec["class_counts"] == {0: 8, 1: 5, 2: 3} and rec["classes_present"] == [0, 1, 2]


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 1)), (2, (1, 0, 1)), (3, (1, 0, 2)), (4, (2, 1, 1)), (8, (4, 2, 2))])
def test_split_sizes(spark, n, want):
    df = spark.createDataFrame([(f"{i:06d}", "snow", 0) for i in range(n)] + [("x", None, 0)], "frame_id string, condition string, dominant int")
    rows = curation.stratified_split(df).collect()
    assert len({r["frame_id"] for r in rows}) == len(rows) == n
    assert tuple(sum(r["split"] == s for r in rows) for s in ("train", "val", "test")) == want


def test_top_frames_keep_input_order(spark):
    df = spark.createDataFrame([("c", 0, "snow", 5), ("b", 1, "snow", 5), ("a", 2, "snow", 5)], "frame_id string, ord long, condition string, object_pixels long")
    assert [r["frame_id"] for r in curation.top_frames(df).orderBy("place").collect()] == ["c", "b"]


GOLDEN_WEATHER = dict(rain=15716, snow=1972, fog=2117)


def test_flags_of_the_published_report(spark):
    """Night rain, fog and snow of the published counts and the rest of each weather by day."""
    night = {"rain": 3161, "fog": 638, "snow": 162}
    rows = [("night", w, n) for w, n in night.items()] + [("day", w, GOLDEN_WEATHER[w] - n) for w, n in night.items()]
    rows += [("night", "clear", 15045), ("day", "clear", 65150)]
    df = spark.createDataFrame(rows, "time string, weather string, n long")
    got = {r["f"]: r["n"] for r in df.groupBy(reports.flags(F.col("time"), F.col("weather")).alias("f")).agg(F.sum("n").alias("n")).collect()}
    by_day = {"normal": 65150, "low_visibility": 1479, "winter_driving": 1810, "wet_road": 12555}
    by_night = {f"{k}+night_driving+night_adverse_weather": n for k, n in zip(["wet_road", "low_visibility", "winter_driving"], night.values(), strict=True)}
    assert got == by_day | by_night | {"night_driving": 15045}


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_transitions_across_buckets(spark, bucket):
    w = ["rain", "rain", "fog", "clear", "clear", "clear", "fog"]
    df = spark.createDataFrame([(i * 2 + (i > 3) * 50, x) for i, x in enumerate(w)], "ord long, weather string")
    got = {(r[0], r[1]): r[2] for r in reports.transitions(df, bucket=bucket).collect()}
    want = {}
    for p in zip(w, w[1:], strict=False):
        want[p] = want.get(p, 0) + 1
    assert got == want


def test_density_and_complexity(spark):
    h = spark.createDataFrame([(4, 1), (5, 2), (15, 3), (16, 4), (51, 1)], "k long, n_frames long")
    assert tuple(reports.traffic_density(h).first()) == (1, 5, 5, 1)
    r = reports.objects_per_frame(h).first()
    values = [4] + [5] * 2 + [15] * 3 + [16] * 4 + [51]
    mean = sum(values) / 11
    assert r["mean"] == pytest.approx(mean, abs=1e-6)
    assert r["std"] == pytest.approx((sum((v - mean) ** 2 for v in values) / 10) ** 0.5, abs=1e-6)


def test_complexity_buckets(spark):
    rows = [(f"{n}", f"c{i}") for n in (2, 3, 6, 7) for i in range(n)] + [("2", "c0")] * 9
    got = {r["complexity"]: (r["n"], r["pct"]) for r in reports.scene_complexity(spark.createDataFrame(rows, "frame_id string, name string")).collect()}
    assert got == {"simple": (1, 25.0), "moderate": (2, 50.0), "complex": (1, 25.0)}
    maps = spark.createDataFrame([({"a": 1, "b": 2},), (None,)], "m map<string, int>")
    assert sorted(tuple(r) for r in reports.map_rows(maps, "m", "k", "v").collect()) == [("a", 1), ("b", 2)]
    assert tuple(maps.select(*c.time_and_weather(F.lit("night_rain"))).first()) == ("night", "rain")


@pytest.mark.parametrize("digits", [1, 2])
def test_split_equals_one_ranking(spark, digits):
    """Ranks in pieces give the places of one ranking; null classes are a stratum, repeated keys keep their rows."""
    rows = [(f"{i:05d}", "snow" if i % 3 else "day_fair", None if i % 7 == 0 else i % 2) for i in range(700)] + [("00001", "snow", 1)]
    got = curation.stratified_split(spark.createDataFrame(rows, "frame_id string, condition string, dominant int"), digits=digits).collect()
    want = []
    for k in {r[1:] for r in rows}:
        own = sorted((r for r in rows if r[1:] == k), key=lambda r: (hashlib.md5((r[0] + "42").encode()).hexdigest(), r[0]))
        a, b = len(own) // 2, len(own) // 4
        want += [(*r, "train" if i < a else "val" if i < a + b else "test") for i, r in enumerate(own)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_frame_sets(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "frame_id string")
    b = spark.createDataFrame([("2",), ("3",)], "frame_id string")
    assert [r[0] for r in fr.available(a, b).collect()] == ["2"]
    assert [r[0] for r in fr.remaining(a, b).collect()] == ["1"]
