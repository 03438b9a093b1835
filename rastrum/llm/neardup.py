"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one class; one row a class goes on.
2. Vectors are scaled to length 1, centred and turned to their principal axes;
   a rotation is then learned that brings them closest to the corners of a
   cube (ITQ, Gong and Lazebnik 2011), on a sample of at most ``SAMPLE``
   numbers, drawn by hash.  Every vector is indexed.
3. The signs are a binary code of ``BITS`` bits.  Each table indexes a
   substring of it, as wide as makes buckets of about ``PER`` vectors; there
   are as many tables as it takes for a pair of just the threshold to be missed
   with a chance of ``MISS``.  Substrings are disjoint while the code lasts,
   then cut from further permutations of it.
4. In each bucket the original vectors are compared, all pairs of it as one
   product of matrices.  A pair counts in the first table that both meet in.
   A bucket of more than ``BLOCK`` vectors is split: its blocks are compared
   two by two in tasks of their own.

The result has a row for each usable vector: its class, the least id of all
vectors that chains of links lead to, and its number of links, vectors of
cosine similarity of at least the threshold, copies and all.  No pair leaves
the task that compares it.

Defined results: null vectors, vectors with a null, NaN or infinite element,
zero vectors and vectors of another than the commonest length (ties: the
longest) are left out, as are null ids; equal vectors always meet; rows with
one id are vectors of their own and may be linked to each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, partitions, split_by
from .text import column, mix64, release

BITS = 64
THRESHOLD = 0.95
STEPS = 12
SEED = 5
#: Numbers of the sample that the rotation is learned on: rows are this by the length of a vector.
SAMPLE = 1 << 22
PER = 64
MISS = 0.01
BLOCK = 4096
#: Most buckets that are split; any other holds no more rows than the least of these, so at most rows * tables / HOT.
HOT = 1 << 20
#: Bytes of entries that a reducer is meant to hold.
REDUCER = 32 << 20


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, key, v): usable vectors of the commonest length and a hash of each."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    d = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), norm.alias("norm"))
    d = d.where("norm > 0 AND norm < double('Infinity')")  # null, NaN and infinity spread to the norm; NaN is the greatest double
    top = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = top["n"] if top else 0
    return d.where(F.size("v") == size).select("id", F.xxhash64("v").alias("key"), "v")


def _matrix(b: pa.RecordBatch, name: str = "v") -> np.ndarray:
    c = column(b, name)
    x = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def learn(x: np.ndarray, bits: int = BITS, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the d x bits matrix whose signs are the code."""
    mean = x.mean(axis=0)
    y = x - mean
    value, axes = np.linalg.eigh(y.T @ y / len(y))
    y = y @ (p := axes[:, np.argsort(-value)[: min(bits, len(value))]])
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((p.shape[1],) * 2))[0]
    for _ in range(steps):
        u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ vt).T
    return mean, p @ turn


def table_masks(rows: int, bits: int, threshold: float, per: int = PER, miss: float = MISS, seed: int = SEED) -> list[int]:
    """The bits of the code that each table is indexed by."""
    width = min(bits, 24, max(1, math.ceil(math.log2(max(2, rows) / per)))) if rows > per else 1
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
    tables = 1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - meet)))
    r = np.random.default_rng(seed)
    order = np.arange(bits)
    masks: list[int] = []
    at = 0
    while len(masks) < tables:
        if at + width > bits:
            order, at = r.permutation(bits), 0
        masks.append(sum(1 << int(b) for b in order[at : at + width]))
        at += width
    return masks


def _codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, w = model
    return ((x - mean) @ w >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(w.shape[1], dtype=np.uint64))


def _bucket(code: np.ndarray, table: int, mask: int) -> np.ndarray:
    """A number of the bucket of each code in a table."""
    return mix64((code & np.uint64(mask)) ^ mix64(np.full(1, table + 1, dtype=np.uint64)))


def _hot(vecs: DataFrame, model: tuple[np.ndarray, np.ndarray], masks: list[int], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of more than ``block`` vectors, HOT of the fullest at most, sorted, and into how many blocks they go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                code = _codes(_matrix(b), model)
                key, n = np.unique(np.concatenate([_bucket(code, t, m) for t, m in enumerate(masks)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    full = vecs.select("v").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    pdf = full.orderBy(F.desc("n"), "bucket").limit(HOT).toPandas()
    key = pdf["bucket"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], -(-pdf["n"].to_numpy(dtype=np.int64)[order] // block)


_SCHEMA = pa.schema([("to", pa.int32()), *((c, pa.binary()) for c in ("buckets", "tasks", "blocks", "tables", "keys", "weights", "codes", "vectors"))])
_KINDS = (np.uint64, np.int64, np.int32, np.int32, np.int64, np.int64, np.uint64, np.float64)


def links(reps: DataFrame, model: tuple[np.ndarray, np.ndarray], masks: list[int], threshold: float, rows: int, block: int = BLOCK) -> DataFrame:
    """(key, root, links): by bucket, how many vectors each is linked to, counted where both meet first, and another one of the same class."""
    hot, pieces = _hot(reps, model, masks, block)
    d = len(model[0])
    reducers = max(partitions(reps.sparkSession), -(-rows * len(masks) * 8 * (d + 6) // REDUCER))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, key, weight = _matrix(b), *(column(b, c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            code = _codes(x, model)
            for t, m in enumerate(masks):
                bucket = _bucket(code, t, m)
                parts = np.ones(len(key), dtype=np.int64)
                if len(hot):
                    p = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
                    parts = np.where(hot[p] == bucket, pieces[p], 1)
                own = (mix64(key.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                ends = np.cumsum(parts)
                i = 0
                while i < len(key):  # a vector of a split bucket goes to the task of its block with each block
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4096, side="right")))
                    row = np.repeat(np.arange(i, j), parts[i:j])
                    other = np.arange(len(row)) - np.repeat(ends[i:j] - parts[i:j] - (ends[i - 1] if i else 0), parts[i:j])
                    task = np.minimum(own[row], other) << 32 | np.maximum(own[row], other)
                    to = (mix64(bucket[row] + mix64(task.astype(np.uint64))) % np.uint64(reducers)).astype(np.int64)
                    cols = (bucket[row], task, own[row], np.full(len(row), t), key[row], weight[row], code[row], x[row])
                    out: list[list] = [[] for _ in _SCHEMA]
                    for k, at in split_by(to, reducers) if reducers <= 1 << 16 else ((int(k), np.flatnonzero(to == k)) for k in np.unique(to)):
                        out[0].append(k)
                        for y, c, kind in zip(out[1:], cols, _KINDS, strict=True):
                            y.append(c[at].astype(kind).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
                    i = j

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(1, len(_SCHEMA))), strict=True)]
        if not got:
            return
        bucket, task, blocks, table, key, weight, code, x = (np.frombuffer(b"".join(r[i] for r in got), k) for i, k in enumerate(_KINDS))
        del got
        x = x.reshape(-1, d)
        order = np.lexsort((key, task, bucket))
        edge = np.flatnonzero(np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (task[order][1:] != task[order][:-1]), [True]]))
        out: list[tuple[np.ndarray, ...]] = []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if j - i > 1:
                at = order[i:j]
                a, b = _near(x[at], blocks[at], code[at], masks[: table[at[0]]], threshold)
                if len(a):
                    n = np.bincount(a, weight[at][b], len(at)) + np.bincount(b, weight[at][a], len(at))
                    root = _joined(len(at), a, b)
                    some = np.flatnonzero(n)
                    out.append((key[at][some], key[at][root[some]], n[some].astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "root", "links"])
        release()

    sent = reps.select("key", "n", "v").mapInArrow(send, "to int, " + ", ".join(f"{f.name} binary" for f in list(_SCHEMA)[1:]))
    return sent.repartition(reducers, "to").mapInArrow(receive, "key long, root long, links long")


def _near(x: np.ndarray, block: np.ndarray, code: np.ndarray, before: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of at least the threshold that meet in none of the tables before; of two blocks only pairs between them."""
    two = block.min() != block.max()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(x), 512):
        a, b = np.nonzero(x[lo : lo + 512] @ x[lo:].T >= threshold - 1e-9)
        a, b = a + lo, b + lo
        keep = (a < b) & (block[a] != block[b]) if two else a < b
        a, b = a[keep], b[keep]
        differ = code[a] ^ code[b]
        first = np.ones(len(a), dtype=bool)
        for m in before:
            first &= (differ & np.uint64(m)) != 0
        a, b = a[first], b[first]
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        found.append((a[exact], b[exact]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least one that pairs (a, b) join it to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


RESULT = "vec_id long, class_id long, n_links long"


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, per: int = PER, miss: float = MISS, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links) of all usable vectors, linked where their cosine similarity is at least ``threshold``."""
    spark = table.sparkSession
    vecs = checkpoint(vectors(table, id_col, vec_col))
    reps = checkpoint(vecs.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")))
    rows = reps.count()
    if not rows:
        return spark.createDataFrame([], RESULT)
    d = len(reps.first()["v"])
    sample = reps.orderBy(F.xxhash64("key"), "key").limit(max(1, SAMPLE // d)).select("v").toArrow().combine_chunks()
    model = learn(_matrix(pa.RecordBatch.from_arrays([sample["v"].combine_chunks()], names=["v"])), bits)
    found = checkpoint(links(reps, model, table_masks(rows, model[1].shape[1], threshold, per, miss), threshold, rows, block))
    joined = components(found.selectExpr("key AS a", "root AS b"))
    per_key = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = reps.select("key", "id", "n").join(per_key, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    linked = checkpoint(linked.select("key", "id", F.coalesce("comp", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    classes = linked.groupBy("root").agg(F.min("id").alias("class_id"))
    named = linked.join(classes, "root").select("key", "class_id", "n_links")
    return vecs.select(F.col("id").alias("vec_id"), "key").join(named, "key").select("vec_id", "class_id", "n_links")
