"""Packing of related documents into windows.

1. Every document gets ``SKETCH`` min-hashes of its word trigrams.  Documents
   with equal sketches (copies) share a node.
2. Nodes that agree in one of ``ROWS`` hashes are neighbours to consider; all
   pairs of a bucket are met, however large it is: one of more than ``SPLIT``
   nodes is compared block by block, in a task for each two blocks.  The
   similarity of two nodes is the share of equal hashes, estimated from their
   low bytes; pairs of at least ``LEAST`` count and each node keeps its
   ``NEIGHBOURS`` most similar ones.
3. Nodes are dealt to shards, components of the graph whole.  A component of
   more words than a shard is dealt by the clusters that links to the most
   similar neighbour join, and one of those that is still too large node by
   node; so are copies of one text that alone are more than a shard.
4. Within a shard and component a walk starts at the unvisited node of lowest
   degree, goes on to the most similar unvisited neighbour and ends where there
   is none; then the next walk starts.
5. Paths are laid end to end within a shard, those of lowest starting degree
   first, and cut into windows of ``window`` words; a document may go on in
   the next window.

Defined results: null, empty and word-less texts take no room and are left
out, as are null ids; a document longer than a window fills several; equal
degrees and similarities go to the smaller id; repeated rows are copies next
to each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import checkpoint, components, grouped, partitions, split_by

N = 3
SKETCH = 64
ROWS = 24
#: Buckets of up to so many nodes are compared together, larger ones in blocks of rows and columns.
SMALL = 64
BLOCK = (256, 1024)
#: Buckets of more nodes are compared by several tasks; HOT is the most buckets that are, the fullest ones.
SPLIT = 8192
HOT = 1 << 20
LEAST = 0.15
NEIGHBOURS = 4
WINDOW = 2048
SHARD_TOKENS = 8_000_000

_rng = np.random.default_rng(2023)
_A = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def min_hashes(w: tx.Words, n: int = N) -> np.ndarray:
    """[document, SKETCH] minima over the hashes of n-grams; documents must have words."""
    g, at = tx.ngram_hashes(w, n)
    x = (g >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(at, w.first[:-1])
    out = np.empty((len(first), SKETCH), dtype=np.uint32)
    for k in range(SKETCH):
        y = x * _A[k]
        y ^= y >> np.uint32(15)
        y *= _C[k] | np.uint32(1)
        out[:, k] = np.minimum.reduceat(y, first)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, sketch) of documents with words: SKETCH 32-bit hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = tx.column(b, "doc_id")
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                some = np.flatnonzero(w.counts)
                if not len(some):
                    continue
                own = tx.Words(w.buf, w.start, w.end, np.searchsorted(some, w.doc), np.append(w.first[some], len(w.start)), w.offsets)
                rows = pa.array([r.tobytes() for r in min_hashes(own)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(some)), pa.array(w.counts[some]), rows], schema=schema)

    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, n_words long, sketch binary")


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of their SKETCH low bytes agree, by rows."""
    return (x == y).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101) >> np.uint64(56)


def _best(a: np.ndarray, b: np.ndarray, n: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each a's ``keep`` distinct b of greatest n, the smaller first where equal."""
    order = np.lexsort((b, -n, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    a, b, n = a[new], b[new], n[new]
    first = np.searchsorted(a, a)
    ok = np.arange(len(a)) - first < keep
    return a[ok], b[ok], n[ok]


def _meet_small(key: np.ndarray, node: np.ndarray, low: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of equal keys (sorted) that agree in ``need`` bytes, both ways."""
    r, same = 1, np.flatnonzero(key[1:] == key[:-1])
    while len(same):
        for i in range(0, len(same), 1 << 16):
            x = same[i : i + (1 << 16)]
            n = _equal(low[x], low[x + r]).astype(np.int64)
            ok = (n >= need) & (node[x] != node[x + r])
            a, b, n = node[x[ok]], node[x[ok] + r], n[ok]
            yield np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([n, n])
        r += 1
        same = same[same + r < len(key)]
        same = same[key[same + r] == key[same]]


def _meet_large(node: np.ndarray, low: np.ndarray, others: np.ndarray, other_low: np.ndarray, need: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``keep`` most similar ``others`` (sorted) of each of the nodes, all pairs met in blocks."""
    t, u = np.ascontiguousarray(low.T), np.ascontiguousarray(other_low.T)
    for i in range(0, len(node), BLOCK[0]):
        rows = slice(i, i + BLOCK[0])
        for j in range(0, len(others), BLOCK[1]):
            cols = slice(j, j + BLOCK[1])
            n = np.zeros((len(node[rows]), len(others[cols])), dtype=np.uint8)
            eq = np.empty(n.shape, dtype=bool)
            for g, h in zip(t, u, strict=True):
                np.equal(g[rows, None], h[None, cols], out=eq)
                n += eq.view(np.uint8)
            n[node[rows, None] == others[None, cols]] = 0
            line = np.arange(len(n))
            for _ in range(min(keep, n.shape[1])):
                best = n.argmax(axis=1)  # the first, of smallest id
                found = n[line, best].astype(np.int64)
                ok = found >= need
                if not ok.any():
                    break
                yield node[rows][ok], others[cols][best[ok]], found[ok]
                n[line, best] = 0


def _keys(sk: np.ndarray) -> np.ndarray:
    """The buckets of sketches, hash by hash."""
    return (np.arange(ROWS, dtype=np.uint64)[:, None] << np.uint64(32) | sk[:, :ROWS].T).ravel()


def _sketch(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(tx.column(b, "sketch").to_pylist()), dtype=np.uint32).reshape(len(b), SKETCH)


def _hot(nodes: DataFrame, split: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of more than ``split`` nodes, HOT of the fullest at most, sorted, and into how many blocks they go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                key, n = np.unique(_keys(_sketch(b)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    full = nodes.select("sketch").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > split)
    pdf = full.orderBy(F.desc("n"), "key").limit(HOT).toPandas().sort_values("key")  # keys are below 2**63
    return pdf["key"].to_numpy(dtype=np.int64).view(np.uint64), -(-pdf["n"].to_numpy(dtype=np.int64) // split)


def neighbours(nodes: DataFrame, least: float = LEAST, keep: int = NEIGHBOURS, split: int = SPLIT) -> DataFrame:
    """(a, b, sim): each node a's most similar nodes b."""
    buckets = partitions(nodes.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "tasks", "blocks", "nodes", "lows"))])
    kinds = (np.uint64, np.int64, np.int32, np.int64, np.uint8)
    # one in 256 bytes agrees by chance
    sims = np.round((np.arange(SKETCH + 1) / SKETCH * 256 - 1) / 255, 6)
    need = max(1, int(np.searchsorted(sims, least)))
    hot, pieces = _hot(nodes, split)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = tx.column(b, "node").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            sk = _sketch(b)
            low = sk.astype(np.uint8)
            key = _keys(sk)
            at = np.tile(np.arange(len(ids)), ROWS)
            parts = np.ones(len(key), dtype=np.int64)
            if len(hot):
                p = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                parts = np.where(hot[p] == key, pieces[p], 1)
            own = (tx.mix64(ids[at].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            ends = np.cumsum(parts)
            i = 0
            while i < len(key):  # a node of a split bucket goes to the task of its block with each block
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 16), side="right")))
                row = np.repeat(np.arange(i, j), parts[i:j])
                other = np.arange(len(row)) - np.repeat(ends[i:j] - parts[i:j] - (ends[i - 1] if i else 0), parts[i:j])
                task = np.minimum(own[row], other) << 32 | np.maximum(own[row], other)
                cols = (key[row], task, own[row], ids[at[row]])
                out: list[list] = [[] for _ in schema]
                for k, x in split_by((tx.mix64(key[row] + tx.mix64(task.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64), buckets):
                    for y, c in zip(out, (k, *(c[x].astype(t).tobytes() for c, t in zip(cols, kinds, strict=False)), low[at[row[x]]].tobytes()), strict=True):
                        y.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(out, schema, strict=True)], schema=schema)
                i = j

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(1, len(schema))), strict=True)]
        if not xs:
            return
        key, task, block, node, low = (np.frombuffer(b"".join(x[i] for x in xs), t) for i, t in enumerate(kinds))
        del xs
        order = np.lexsort((node, block, task, key))
        key, task, block, node, low = key[order], task[order], block[order], node[order], low.reshape(-1, SKETCH)[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (task[1:] != task[:-1])])
        first, group = np.flatnonzero(new), np.cumsum(new)
        size = np.diff(np.append(first, len(key)))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
            yield from _meet_small(group[small], node[small], low[small], need)
            for i in np.flatnonzero(size > SMALL):
                a, b = first[i], first[i] + size[i]
                cut = a + int(np.searchsorted(block[a:b], block[a], side="right"))
                if cut == b:
                    yield from _meet_large(node[a:b], low[a:b], node[a:b], low[a:b], need, keep)
                else:  # two blocks: only pairs between them
                    yield from _meet_large(node[a:cut], low[a:cut], node[cut:b], low[cut:b], need, keep)
                    yield from _meet_large(node[cut:b], low[cut:b], node[a:cut], low[a:cut], need, keep)

        total = 0
        for x in pairs():
            held.append(x)
            total += len(x[0])
            if total > 1 << 20:
                held = [_best(*(np.concatenate(y) for y in zip(*held, strict=True)), keep)]
                total = len(held[0][0]) // 2  # what stays is met again only when as much has come
        if held:
            a, b, n = _best(*(np.concatenate(y) for y in zip(*held, strict=True)), keep)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sims[n])], names=["a", "b", "sim"])
        tx.release()

    sent = nodes.select("node", "sketch").mapInArrow(send, "bucket int, " + ", ".join(f"{f.name} binary" for f in list(schema)[1:]))
    met = sent.repartition(buckets, "bucket").mapInArrow(receive, "a long, b long, sim double")
    # a pair that two nodes of one id gave, or several buckets, counts once
    met = met.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return met.selectExpr("*", "row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place").where(F.col("place") <= keep).select("a", "b", "sim")


def walk(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, degree of the path's start, path, place) of greedy paths through a graph, given both directions of its edges; a node without edges has one to itself."""
    near: dict[int, list[tuple[float, int]]] = {}
    for x, y, s in zip(a.tolist(), b.tolist(), sim.tolist(), strict=True):
        own = near.setdefault(x, [])
        if x != y:
            own.append((-s, y))
    for v in near.values():
        v.sort()
    degree = {x: len(v) for x, v in near.items()}
    visited: set[int] = set()
    out = []
    for start in sorted(near, key=lambda x: (degree[x], x)):
        at, place = start, 0
        while at is not None and at not in visited:
            visited.add(at)
            out.append((at, degree[start], start, place))
            place += 1
            at = next((y for _, y in near[at] if y not in visited), None)
    return out


def shards_of(nodes: DataFrame, edges: DataFrame, shards: int, shard_tokens: int) -> DataFrame:
    """(node, comp, shard) of the nodes (node, words) that have edges."""
    own = nodes.join(components(edges), "node").select("node", "words", "comp")
    large = checkpoint(own.groupBy("comp").agg(F.sum("words").alias("w")).where(F.col("w") > shard_tokens).select("comp"))
    unit = F.col("comp")
    if not large.isEmpty():
        own = checkpoint(own.join(large.withColumn("large", F.lit(True)), "comp", "left"))
        best = edges.groupBy("a").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("b"))
        inner = own.where("large").join(components(best.join(own.where("large").select(F.col("node").alias("a")), "a")).withColumnRenamed("comp", "cluster"), "node")
        parts = inner.groupBy("cluster").agg(F.ceil(F.sum("words") / shard_tokens).alias("parts"))
        piece = inner.join(parts, "cluster").select("node", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), "parts")).alias("piece"))
        own = own.join(piece, "node", "left")
        unit = F.coalesce("piece", "comp")
    return own.select("node", "comp", F.pmod(F.xxhash64(unit), F.lit(shards)).alias("shard"))


def paths(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, shard, degree, path, place): walks within each shard and component."""
    a, b = placed.select(F.col("node").alias("a"), "comp", "shard"), placed.select(F.col("node").alias("b"), F.col("shard").alias("other"))
    kept = edges.join(a, "a").join(b, "b").where("shard = other").select("shard", "comp", "a", "b", "sim")
    kept = kept.unionByName(a.select("shard", "comp", "a", F.col("a").alias("b"), F.lit(0.0).alias("sim")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (shard, _), t in grouped(batches, ["shard", "comp"]):
            out += [(x[0], shard, *x[1:]) for x in walk(*(t[c].to_numpy() for c in ("a", "b", "sim")))]
            if len(out) > 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "shard", "degree", "path", "place"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "shard", "degree", "path", "place"])

    sorted_ = kept.repartition(partitions(edges.sparkSession), "shard").sortWithinPartitions("shard", "comp")
    return sorted_.mapInArrow(run, "node long, shard long, degree long, path long, place long")


RESULT = "shard, window, place, doc_id, start_word, n_words"


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of documents in each window: (shard, window, place, doc_id, start_word, n_words)."""
    spark = docs.sparkSession
    found = checkpoint(sketches(docs, id_col, text_col).withColumn("key", F.xxhash64("sketch")))
    total = found.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    words = F.sum("n_words")
    nodes = checkpoint(found.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), words.alias("words"), F.ceil(words / shard_tokens).alias("parts")))
    near = neighbours(nodes)
    edges = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    edges = checkpoint(edges)
    own = nodes.groupBy("node").agg(F.max(F.least("words", F.lit(shard_tokens))).alias("words"))  # two texts of one id may share a node
    walks = paths(edges, checkpoint(shards_of(own, edges, shards, shard_tokens)))
    # copies beyond a shard are dealt to others; nodes without neighbours are paths of their own
    d = found.join(nodes.select("key", "node", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    d = d.select("doc_id", "n_words", "node", "part", F.when(F.col("part") == 0, F.col("node")).alias("walker"))
    d = d.join(walks.withColumnRenamed("node", "walker"), "walker", "left")
    alone = F.pmod(F.xxhash64("node", "part"), F.lit(shards))
    placed = d.select("doc_id", "n_words", "node", F.coalesce("shard", alone).alias("shard"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("path", "node").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))
    return spark.sql(
        f"""WITH c AS (SELECT *, (sum(n_words) OVER w) - n_words AS before, row_number() OVER w AS place_in_shard
                FROM {{placed}} WINDOW w AS (PARTITION BY shard ORDER BY degree, path, place, node, doc_id, n_words ROWS UNBOUNDED PRECEDING)),
            p AS (SELECT *, explode(sequence(before DIV {window}, (before + n_words - 1) DIV {window})) AS window FROM c)
        SELECT shard, window, place_in_shard AS place, doc_id,
            greatest(0L, window * {window} - before) AS start_word,
            least((window + 1) * {window}, before + n_words) - greatest(window * {window}, before) AS n_words
        FROM p""",
        placed=placed,
    )
