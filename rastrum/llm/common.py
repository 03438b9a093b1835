"""What the operators share: shared-folder tables, bounded membership filters, groups of sorted batches, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter: its table, which is broadcast, has FILTER_BITS / 64 rows of 16 bytes at most.
FILTER_BITS = 1 << 26
#: Bytes of a row group of a written table.
ROW_GROUP = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset on one machine, as in tests, a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "rastrum-shared")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through files in the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    A row may hold megabytes: the writer looks at what it has gathered from the
    first row on, where by default it lets 100 rows pass, and readers decode
    ROW_GROUP at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rastrum/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    w.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1000).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    for f in df.inputFiles():
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def clean(spark: SparkSession) -> None:
    """Removes all tables that written() has left in the shared folder; results that read them must be stored by then."""
    _delete(spark, f"{shared_dir(spark)}/rastrum")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df with the column __in: false only where ``on`` is surely not among ``keys``.

    Keys are hashed into FILTER_BITS bits, of which the words that have any are
    broadcast: 16 MB at most, whatever the number of keys.  The more keys there
    are, the more others pass; nothing is ever lost.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = keys.select(at(F.col(on)).alias("__h")).groupBy(F.shiftright("__h", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(__h & 63 AS INT))")).alias("__bits"))
    d = df.withColumn("__h", at(F.col(on))).withColumn("__w", F.shiftright("__h", 6)).join(F.broadcast(words), "__w", "left")
    return d.withColumn("__in", F.coalesce(F.expr("getbit(__bits, CAST(__h & 63 AS INT)) = 1"), F.lit(False)) & F.col(on).isNotNull()).drop("__w", "__h", "__bits")


def perhaps(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key may be among ``keys``: all that are and, by chance, some that are not."""
    return maybe(df, keys, on).where("__in").drop("__in")


def within(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is among ``keys``; only those that the filter lets through take part in the join."""
    return perhaps(df, keys, on).join(keys.select(on), on, "left_semi").select(df.columns)


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is null or not among ``keys``; only those that the filter holds back take part in the join."""
    d = maybe(df, keys, on)
    sure = d.where("NOT __in").select(df.columns)
    return sure.unionByName(d.where("__in").join(keys.select(on), on, "left_anti").select(df.columns))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal keys in batches sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(b), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        at = np.append(np.flatnonzero(new), len(b))
        for i, j in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[i].item() for c in cols)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of an undirected graph; comp is the least node id of the component.

    Rounds of large-star and small-star (Kiveris et al. 2014) until nothing
    changes: O(log^2 n) rounds.  A node's least neighbour is joined to its
    edges, so that no row holds all neighbours of a node and the rows of a hub
    may be split.  Nulls and self-edges are left out; an empty graph has no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: the greater end u of each edge goes to the least neighbour of the lesser end v
        least = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v")).distinct()  # its exchange serves both uses below
        # small star: each lesser neighbour of u, and u, goes to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def as_batches(it: Iterator[dict[str, object]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for cols in it:
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def pack(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers, of which the high ones are mostly 0."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + len(x).to_bytes(8, "little")


def unpack(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[-8:], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[:-8], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def split_by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each value of key below n that occurs, the places where it does, in order."""
    if n <= 1 << 16:
        key = key.astype(np.uint16)  # sorted by radix
    order = np.argsort(key, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])
    for k in range(n):
        if at[k + 1] > at[k]:
            yield k, order[at[k] : at[k + 1]]
