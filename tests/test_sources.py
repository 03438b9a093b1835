"""Files in and out."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from rastrum.operators import raster_np
from rastrum.sources import dataset, files, sinks
from rastrum.streaming import ingest


def test_lists_and_metadata(spark, tmp_path):
    (tmp_path / "list.txt").write_text("camera/frame_000002.png\n\n 000001 \n000003\n")
    f = files.frame_list(spark, str(tmp_path / "list.txt"))
    assert [r["frame_id"] for r in f.orderBy("ord").collect()] == ["000002", "000001", "000003"]
    for i, w in (("000001", "rain"), ("000002", None)):
        d = tmp_path / "frames" / i
        d.mkdir(parents=True)
        (d / "metadata.json").write_text(json.dumps({"scraped_weather": w, "time_of_day": "night", "other": 1}, indent=1))
    (tmp_path / "frames" / "000001" / "objects.json").write_text(json.dumps([{"name": "Vehicle", "box2d": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}}, {"name": "Animal"}]))
    m = files.with_metadata(f, files.metadata(spark, str(tmp_path / "frames")))
    assert {r["frame_id"]: (r["scraped_weather"], r["has_metadata"]) for r in m.collect()} == {"000001": ("rain", True), "000002": (None, True), "000003": (None, False)}
    p = files.presence(spark, str(tmp_path / "frames"), ["metadata.json", "objects.json"])
    assert {r["frame_id"]: r["objects_json"] for r in p.collect()} == {"000001": True, "000002": False}
    dataset.register(spark)
    o = spark.read.format("frames").load(str(tmp_path / "frames")).orderBy("seq").collect()
    assert [(r["frame_id"], r["name"], r["box2d"] and r["box2d"]["xmax"]) for r in o] == [("000001", "Vehicle", 3.0), ("000001", "Animal", None)]


def test_png_round_trip_and_resume(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([("000007", 3, 4, bytearray(a.tobytes())), ("000008", 3, 4, None)], "frame_id string, h int, w int, data binary")
    out = str(tmp_path / "png")
    assert sorted(tuple(r) for r in sinks.write_pngs(df, out).collect()) == [("000007", "success"), ("000008", "error")]
    assert sorted(r["status"] for r in sinks.write_pngs(df, out).collect()) == ["error", "skip"]
    r = files.images(spark, out).first()
    assert (r["frame_id"], r["h"], r["w"], r["channels"]) == ("000007", 3, 4, 1) and bytes(r["data"]) == a.tobytes()
    assert [r[0] for r in files.frames_in(spark, out).collect()] == ["000007"]
    assert files.folder_size(files.listing(spark, out)).first()["files"] == 1
    assert files.latest(files.listing(spark, out)).first()[0].endswith("frame_000007.png")


def test_points_sink_is_idempotent(spark, tmp_path):
    p = spark.createDataFrame([("a", 1), ("b", 2)], "frame_id string, v int")
    sinks.write_points(p.where("frame_id = 'a'"), str(tmp_path / "pts"), 4)
    sinks.write_points(p, str(tmp_path / "pts"), 4)
    assert sorted(r["frame_id"] for r in spark.read.parquet(str(tmp_path / "pts")).collect()) == ["a", "b"]
    rec = spark.createDataFrame([("a", [1], [1]), ("b", None, [1]), ("c", [1], [1, 2])], "frame_id string, points_3d array<int>, camera_coordinates array<int>")
    good, bad = files.valid_points(rec)
    assert [r[0] for r in good.collect()] == ["a"] and {r["frame_id"]: r["reason"] for r in bad.collect()} == {"b": "missing", "c": "lengths differ"}


def test_splits_and_report(spark, tmp_path):
    s = spark.createDataFrame([("2", "train", "snow"), ("1", "train", "snow"), ("3", "test", "day_fair")], "frame_id string, split string, condition string")
    sinks.write_splits(s, str(tmp_path))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "splits" / "split=train")).collect()]
    assert lines == ["camera/frame_1.png", "camera/frame_2.png"]
    rep = sinks.report(spark.createDataFrame([("1", {2: 5})], "frame_id string, class_counts map<int, long>"), 3).orderBy("frame_id").collect()
    assert json.loads(rep[0]["json"])["total_frames"] == 3 and json.loads(rep[1]["json"])["class_counts"] == {"2": 5}


def test_failed_frames_have_a_status(spark):
    df = spark.createDataFrame([("a", 2, 2, bytearray(4)), ("b", 2, 2, bytearray(3))], "frame_id string, h int, w int, data binary")
    got = {r["frame_id"]: r["status"] for r in raster_np.per_frame(df, lambda a: a, 1).collect()}
    assert got == {"a": "ok", "b": "error: ValueError"}


def test_stream(spark, tmp_path):
    rows = [("1", "2024-01-01 00:10:00", "rain", "night", True), ("1", "2024-01-01 00:10:00", "rain", "night", True), ("2", "2024-01-01 00:20:00", "clear", "day", True), ("3", "2024-01-01 05:00:00", None, None, False)]
    df = spark.createDataFrame(rows, "frame_id string, ts string, scraped_weather string, time_of_day string, has_metadata boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.condition_counts(ingest.frame_stream(spark, str(tmp_path / "in"), df.schema))
    q = s.writeStream.outputMode("complete").format("memory").queryName("conditions").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["condition"], r["n"]) for r in spark.sql("SELECT * FROM conditions").collect()} == {("night_rain", 1), ("day_fair", 1), (None, 1)}
    for _ in range(2):
        ingest.write_new(df.dropDuplicates(["frame_id"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
