"""Dense raster kernels, one frame at a time, for what relational operators cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = np.array([[0, 0, 0], [128, 128, 128], [0, 0, 255], [255, 255, 0], [255, 0, 255], [255, 0, 0]], dtype=np.uint8)


def box_count(mask: np.ndarray, reach: int = 3) -> np.ndarray:
    """Set cells in the square around each cell, zeros beyond the border, from the integral image."""
    h, w = mask.shape
    s = np.zeros((h + 2 * reach + 1, w + 2 * reach + 1), dtype=np.int64)
    s[reach + 1 : reach + 1 + h, reach + 1 : reach + 1 + w] = mask
    s = s.cumsum(0).cumsum(1)
    k = 2 * reach + 1
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected labels (0 is unset, numbered by first cell in row order) and the areas of labels 1, 2, ..."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(lab, 1)
        big = np.where(p > 0, p, np.iinfo(np.int64).max)
        least = np.minimum.reduce([big[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        new = np.where(mask, least, 0)
        # jump to the label of the cell that the label names, which halves long chains
        new = np.where(mask, np.minimum(new, new.ravel()[np.maximum(new, 1) - 1]), 0)
        if (new == lab).all():
            break
        lab = new
    ids, back, n = np.unique(lab, return_inverse=True, return_counts=True)
    shift = 0 if len(ids) and ids[0] == 0 else 1
    return back.reshape(h, w) + shift, n[1 - shift :]


def gaussian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Separable blur with an odd kernel of about 6 sigma, zeros beyond the border."""
    k = int(6 * sigma) + 1
    k += 1 - k % 2
    t = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    t /= t.sum()
    pad = k // 2
    out = a.astype(np.float64)
    for axis in (0, 1):
        p = np.pad(out, [(pad, pad) if i == axis else (0, 0) for i in range(out.ndim)])
        out = sum(t[i] * np.take(p, np.arange(i, i + out.shape[axis]), axis) for i in range(k))
    return out


def distance(mask: np.ndarray, most: int = 8) -> np.ndarray:
    """Euclidean distance of each cell to the nearest set one, exact up to ``most``, infinite beyond."""
    h, w = mask.shape
    best = np.full((h, w), np.inf)
    p = np.pad(mask, most)
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            d = (dy * dy + dx * dx) ** 0.5
            if d <= most:
                best = np.where(p[most + dy : most + dy + h, most + dx : most + dx + w], np.minimum(best, d), best)
    return best


def _spread(a: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    r = max(max(abs(y), abs(x)) for y, x in offsets)
    p = np.pad(a, [(r, r), (r, r), *[(0, 0)] * (a.ndim - 2)])
    h, w = a.shape[:2]
    return np.maximum.reduce([p[r + y : r + y + h, r + x : r + x + w] for y, x in offsets])


#: The usual 7 x 7 elliptic element: 1, 5, 7, 7, 7, 5 and 1 cells a row.
_ELLIPSE = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if abs(x) <= round((9 - y * y) ** 0.5)]


def gap_filled(a: np.ndarray, reach: float = 3.0) -> np.ndarray:
    """In each channel, empty cells within ``reach`` of a filled one take the channel's elliptic 7 x 7 dilation, by nearness."""
    out = a.astype(np.float64)
    spread = _spread(out, _ELLIPSE)
    for c in range(a.shape[2]):
        filled = a[:, :, c] > 0
        d = distance(filled, int(reach) + 1)
        gap = ~filled & (d <= reach)
        out[gap, c] = a[gap, c] * (1 - 1 / (d[gap] + 1)) + spread[gap, c] / (d[gap] + 1)
    return out


def dilated(a: np.ndarray, rounds: int = 3) -> np.ndarray:
    """An elliptic 7 x 7 dilation of each channel, repeated; only cells that are newly covered in the channel change."""
    out = a
    for _ in range(rounds):
        out = _spread(out, _ELLIPSE)
    return np.where((a <= 0) & (out > 0), out, a)


def max_scaled(a: np.ndarray) -> np.ndarray:
    """Each channel scaled so that its maximum is 255, cut to bytes."""
    top = a.max(axis=(0, 1), keepdims=True)
    return np.clip(np.where(top > 0, a / np.where(top > 0, top, 1) * 255, a), 0, 255).astype(np.uint8)


def enhanced(a: np.ndarray) -> np.ndarray:
    """The steps after weighted placement: blur, gap filling, dilation, scaling."""
    return max_scaled(dilated(gap_filled(gaussian(a))))


def nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    y, x = np.minimum(np.arange(h) * a.shape[0] // h, a.shape[0] - 1), np.minimum(np.arange(w) * a.shape[1] // w, a.shape[1] - 1)
    return a[y[:, None], x]


def bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    shape = (-1, 1) + (1,) * (a.ndim - 2)
    fy, fx = (y - y0).reshape(shape), (x - x0).reshape(shape[1:] if a.ndim == 3 else (-1,))
    b = a.astype(np.float64)
    top = b[y0][:, x0] * (1 - fx) + b[y0][:, x1] * fx
    low = b[y1][:, x0] * (1 - fx) + b[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(a.dtype)


def overlay(image: np.ndarray, label: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """The image with label colours blended over labelled cells."""
    mixed = image * (1 - alpha) + COLOURS[label] * alpha
    return np.where((label > 0)[:, :, None], mixed, image).astype(np.uint8)


def outlined(image: np.ndarray, boxes: np.ndarray, colour: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    out = image.copy()
    for x0, y0, x1, y1 in boxes:
        out[y0, x0:x1] = out[y1 - 1, x0:x1] = colour
        out[y0:y1, x0] = out[y0:y1, x1 - 1] = colour
    return out


SCHEMA = "frame_id string, h int, w int, status string, data binary"


def per_frame(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], channels: int = 3, dtype: type = np.uint8) -> DataFrame:
    """A kernel from every dense raster (frame_id, h, w, data) to one of bytes; a frame it fails on has its status and no data."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                try:
                    a = np.frombuffer(r.data, dtype).reshape((r.h, r.w, channels) if channels > 1 else (r.h, r.w))
                    b = kernel(a)
                    out.append((r.frame_id, b.shape[0], b.shape[1], "ok", b.astype(np.uint8).tobytes()))
                except Exception as e:  # a bad frame must not fail the job
                    out.append((r.frame_id, r.h, r.w, f"error: {type(e).__name__}", None))
            yield pd.DataFrame(out, columns=["frame_id", "h", "w", "status", "data"])

    return rasters.select("frame_id", "h", "w", "data").mapInPandas(run, SCHEMA)


def whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Table]]:
    """(ids, frame, rows) of batches in which the rows of one frame_id follow each other: the frames of about one batch, and the place in ids of each row's frame."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Array, np.ndarray, pa.Table]:
        t = pa.Table.from_batches(held)
        held.clear()
        d = t.column("frame_id").combine_chunks().dictionary_encode(null_encoding="encode")
        return d.dictionary, d.indices.to_numpy(), t

    for b in batches:
        if not len(b):
            continue
        at = b.schema.get_field_index("frame_id")
        if held and held[-1].column(at)[-1].as_py() != b.column(at)[0].as_py():
            yield out()
        frame = b.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
        last = int(np.flatnonzero(frame == frame[-1])[0])  # where the last frame begins, which may go on in the next batch
        if last:
            held.append(b.slice(0, last))
            yield out()
        held.append(b.slice(last))
    if held:
        yield out()


def dense(cells: DataFrame, h: int, w: int, channels: list[str], dtype: type = np.uint8) -> DataFrame:
    """Dense rasters of sparse cells (frame_id, y, x, channels...)."""
    schema = pa.schema([("frame_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("status", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, frame, t in whole_frames(batches):
            a = np.zeros((len(ids), h, w, len(channels)), dtype=dtype)
            y, x, *values = (t.column(c).to_numpy() for c in ("y", "x", *channels))
            a[frame, y, x] = np.stack(values, axis=-1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([v] * len(ids), f.type) for v, f in zip((h, w, "ok"), list(schema)[1:], strict=False)), pa.array([r.tobytes() for r in a], pa.binary())], schema=schema)

    return cells.select("frame_id", "y", "x", *channels).repartition("frame_id").sortWithinPartitions("frame_id").mapInArrow(run, SCHEMA)


def painted(frame: np.ndarray, class_id: np.ndarray, y: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], n: int, h: int, w: int) -> np.ndarray:
    """The n label rasters of boxes of cells, ends included; the greatest class stays."""
    out = np.zeros(n * h * w, dtype=np.uint8)
    tall, wide = y[1] - y[0] + 1, x[1] - x[0] + 1
    steps = lambda m: np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    for c in np.unique(class_id):
        i = np.flatnonzero(class_id == c)
        row = np.repeat((frame[i] * h + y[0][i]) * w + x[0][i], tall[i]) + steps(tall[i]) * w
        m = np.repeat(wide[i], tall[i])
        out[np.repeat(row, m) + steps(m)] = c
    return out.reshape(n, h, w)


def sparse(ids: pa.Array, rasters: np.ndarray) -> pa.RecordBatch:
    """The set cells of label rasters, as ``cells_of`` takes them: one row a frame."""
    n, h, w = rasters.shape
    flat = rasters.reshape(-1)
    at = np.flatnonzero(flat)
    first = np.searchsorted(at, np.arange(n + 1) * (h * w)).astype(np.int32)
    code = (at % (h * w) << 8 | flat[at]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, w, np.int32)), pa.ListArray.from_arrays(pa.array(first), pa.array(code))], names=["frame_id", "w", "cells"])


SPARSE = "frame_id string, w int, cells array<int>"


def cells_of(lists: DataFrame) -> DataFrame:
    """(frame_id, y, x, class_id), one row a cell, of the lists that ``sparse`` makes; nothing is grouped."""
    c = lists.select("frame_id", "w", F.explode("cells").alias("c"))
    return c.selectExpr("frame_id", "CAST(shiftright(c, 8) div w AS INT) AS y", "shiftright(c, 8) % w AS x", "c & 255 AS class_id")


def class_counts(rasters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes above 0 that occur, and the cells of each raster that have them: (classes,), (rasters, classes)."""
    classes = np.flatnonzero(np.bincount(rasters.reshape(-1), minlength=1))
    classes = classes[classes > 0]
    by = np.ascontiguousarray(rasters.reshape(len(rasters), -1).T)  # adding up over rows is fast
    return classes, np.stack([(by == c).sum(axis=0, dtype=np.uint32) for c in classes], axis=1) if len(classes) else np.zeros((len(rasters), 0), np.uint32)


def regions(rasters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raster, class, number, area) of the 8-connected regions of each class of label rasters, numbered in each class by first cell in row order.

    Runs of equal cells in a row are linked to the runs of the next row that they touch.
    """
    n, h, w = rasters.shape
    wide = w + 1  # each row ends in an empty cell
    a = np.zeros((n * h, wide), dtype=np.uint8)
    a[:, :w] = rasters.reshape(n * h, w)
    a = a.reshape(-1)
    edge = np.flatnonzero(a[1:] != a[:-1])
    first = np.concatenate([[0], edge + 1])
    last = np.concatenate([edge, [len(a) - 1]])
    some = a[first] > 0
    first, last = first[some], last[some]
    label, row = a[first], first // wide
    lo = np.searchsorted(last, first + wide - 1)
    hi = np.searchsorted(first, last + wide + 1, side="right")
    m = np.where((row + 1) % h > 0, hi - lo, 0)
    x = np.repeat(np.arange(len(first)), m)
    y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    same = label[x] == label[y]
    x, y = x[same], y[same]
    root = np.arange(len(first))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (above := root[root]).tobytes() != root.tobytes():
            root = above
    area = np.bincount(root, weights=last - first + 1, minlength=len(root)).astype(np.int64)
    top = np.flatnonzero(root == np.arange(len(root)))
    top = top[np.lexsort((top, label[top], row[top] // h))]
    frame, label = row[top] // h, label[top]
    new = np.flatnonzero(np.concatenate([[True], (frame[1:] != frame[:-1]) | (label[1:] != label[:-1])])) if len(top) else np.zeros(0, np.int64)
    number = np.arange(len(top)) - np.repeat(new, np.diff(np.append(new, len(top)))) + 1
    return frame, label, number, area[top]


AREAS = "frame_id string, class_id int, component int, area long"
CLASS_AREAS = "frame_id string, class_id int, n long"


def component_areas(ids: pa.Array, rasters: np.ndarray) -> pa.RecordBatch:
    """(frame_id, class_id, component, area) of the 8-connected regions of each class of label rasters."""
    frame, label, number, area = regions(rasters)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(frame)), pa.array(label.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(area)], names=["frame_id", "class_id", "component", "area"])


def class_areas(ids: pa.Array, rasters: np.ndarray) -> pa.RecordBatch:
    """(frame_id, class_id, n) of each class above 0 of label rasters."""
    classes, n = class_counts(rasters)
    frame, at = np.nonzero(n)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(frame)), pa.array(classes[at].astype(np.int32)), pa.array(n[frame, at].astype(np.int64))], names=["frame_id", "class_id", "n"])
