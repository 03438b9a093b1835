"""A Python data source over a folder of frames: ``spark.read.format("frames").load(root)``.

Each frame folder has ``objects.json``, a list of annotated objects; the folders
are spread over partitions, and each is read where its partition runs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "frame_id string, seq int, name string, box2d struct<xmin: double, ymin: double, xmax: double, ymax: double>"


class _Folders(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class FrameReader(DataSourceReader):
    def __init__(self, root: str, parts: int) -> None:
        self.root, self.parts = root, parts

    def partitions(self) -> list[InputPartition]:
        names = sorted(e.name for e in os.scandir(self.root) if e.is_dir())
        return [_Folders(names[i :: self.parts]) for i in range(min(self.parts, max(1, len(names))))]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.root, name, "objects.json")
            if not os.path.exists(path):
                continue
            with open(path, encoding="utf-8") as f:
                for i, o in enumerate(json.load(f)):
                    b = o.get("box2d")
                    yield name, i, o.get("name"), tuple(float(b[k]) for k in ("xmin", "ymin", "xmax", "ymax")) if b else None


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("partitions", 8)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
