"""Images, reports and split lists as files."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.functions.conditions import CLASS_NAMES, frame_path


def png(a: np.ndarray) -> bytes:
    """PNG bytes of an 8-bit grey (h, w) or RGB (h, w, 3) array."""
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1).astype(np.uint8)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def write_pngs(rasters: DataFrame, folder: str) -> DataFrame:
    """Writes each raster (frame_id, h, w, data) as folder/frame_{id}.png on a filesystem all workers share, and returns (frame_id, status).

    A file appears whole or not at all, and one that is there is skipped, so
    that retried tasks and resumed runs are safe.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                path = f"{folder}/frame_{r.frame_id}.png"
                if os.path.exists(path):
                    out.append((r.frame_id, "skip"))
                elif r.data is None:
                    out.append((r.frame_id, "error"))
                else:
                    a = np.frombuffer(r.data, np.uint8)
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(png(a.reshape(r.h, r.w, -1) if len(a) > r.h * r.w else a.reshape(r.h, r.w)))
                    os.replace(part, path)
                    out.append((r.frame_id, "success"))
            yield pd.DataFrame(out, columns=["frame_id", "status"])

    return rasters.select("frame_id", "h", "w", "data").mapInPandas(run, "frame_id string, status string")


def report(records: DataFrame, total: int) -> DataFrame:
    """One JSON text a frame, led by one of the report's head; the caller writes them."""
    names = F.create_map(*[F.lit(x) for k, v in CLASS_NAMES.items() for x in (str(k), v)])
    head = records.sparkSession.range(1).select(F.lit("").alias("frame_id"), F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(total).alias("total_frames"), names.alias("class_names"))).alias("json"))
    return head.unionByName(records.select("frame_id", F.to_json(F.struct(*records.columns)).alias("json")))


def write_splits(split: DataFrame, folder: str) -> None:
    """Sorted path lists: folder/{split} for each split, folder/test_by_condition/condition=... for each condition of the test split."""
    paths = split.select("frame_id", "split", "condition", frame_path(F.col("frame_id")).alias("path"))
    paths.repartition("split").sortWithinPartitions("split", "frame_id").select("split", "path").write.mode("overwrite").partitionBy("split").text(f"{folder}/splits")
    test = paths.where("split = 'test'").repartition("condition").sortWithinPartitions("condition", "frame_id")
    test.select("condition", "path").write.mode("overwrite").partitionBy("condition").text(f"{folder}/test_by_condition")


def write_points(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Projected points as Parquet by frame bucket; frames that are there already stay as they are."""
    bucketed = points.withColumn("bucket", F.pmod(F.xxhash64("frame_id"), F.lit(buckets)))
    try:
        done = points.sparkSession.read.parquet(path).select("frame_id").distinct()
        bucketed = bucketed.join(done, "frame_id", "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    bucketed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
