"""Exact top-k search by the three-phase uniform threshold algorithm.

A document's score for a query is the sum of the weights of the word trigrams
they share; a trigram weighs round(1000 ln(N / df)) over all N documents with
text, at least 1.  The sum is spread over ``LISTS`` local score lists by the
trigrams' hash (Cao and Wang, 2004):

1. every list sends its k best entries of each query; the k-th best partial
   sum is a lower bound of the k-th score;
2. the bound over the number of lists is broadcast as a safe cutoff; all
   entries at or above it are collected, which gives a better bound and, for
   each document seen, an upper bound;
3. documents whose upper bound reaches the lower one are resolved exactly.

Texts are read once: the scan keeps, of each document, the query trigrams in it.

Defined results: every row of the query table is a query, rows with one id
together; null, empty and word-less texts match nothing; a text shorter than
three words is one gram; ties go to the smaller document id; documents with
score 0 are no results, so that a query can have fewer than k; several rows
with one document id count as one document, of the union of their grams; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import checkpoint, within

K = 10
N = 3
LISTS = 4
#: Queries handled in one pass; a larger query table takes several passes.
QUERIES = 20_000


class Queries:
    """The grams of some queries, sorted, and for each the queries that hold it."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, n: int) -> None:
        w = tx.words(*tx.raw(texts))
        g, at = tx.ngram_hashes(w, n)
        pair = np.unique(np.stack([g, ids[w.doc[at]].astype(np.int64).view(np.uint64)], axis=1), axis=0)
        self.ids = np.unique(ids)
        self.grams, first = np.unique(pair[:, 0], return_index=True)
        self.first = np.append(first, len(pair))
        self.query = np.searchsorted(self.ids, pair[:, 1].view(np.int64))
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of g are grams of queries, and their numbers."""
        maybe = np.flatnonzero(self.near[(g >> np.uint64(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.grams, g[maybe]), max(0, len(self.grams) - 1))
        hit = self.grams[p] == g[maybe] if len(self.grams) else np.zeros(0, bool)
        return maybe[hit], p[hit]


def matches(docs: DataFrame, q: Queries, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, grams): of each document, the numbers of the query grams in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = tx.column(b, "doc_id")
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                g, at = tx.ngram_hashes(w, n)
                hit, number = q.of(g)
                pair = np.unique(w.doc[at[hit]] << 32 | number)
                doc = pair >> 32
                some, first = np.unique(doc, return_index=True)
                parts = np.split((pair & 0xFFFFFFFF).astype(np.uint32), first[1:]) if len(some) else []
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(some)), pa.array([x.tobytes() for x in parts], pa.binary())], schema=schema)

    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, grams binary")


def _distinct(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The (row, gram) of a batch, each once."""
    blobs = tx.column(b, "grams").to_pylist()
    row = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
    pair = np.unique(row << 32 | np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64))
    return pair >> 32, pair & 0xFFFFFFFF


def _local(b: pa.RecordBatch, q: Queries, weight: np.ndarray, lists: int) -> tuple[np.ndarray, ...]:
    """(document, query, list, score) entries of a batch."""
    ids = tx.column(b, "doc_id").to_numpy(zero_copy_only=False)
    row, g = _distinct(b)
    many = q.first[g + 1] - q.first[g]
    at = np.repeat(q.first[g] - np.cumsum(many) + many, many) + np.arange(many.sum())
    row, gram, query = np.repeat(row, many), np.repeat(g, many), q.query[at]
    key = (row * len(q.ids) + query) * lists + (q.grams[gram] % np.uint64(lists)).astype(np.int64)
    key, back = np.unique(key, return_inverse=True)
    score = np.bincount(back, weight[gram], len(key)).astype(np.int64)
    return ids[key // lists // len(q.ids)], key // lists % len(q.ids), key % lists, score


ENTRY = "doc_id long, query int, list int, score long"


def _entries(found: DataFrame, q: Queries, weight: np.ndarray, lists: int, k: int = 0, cutoff: np.ndarray | None = None) -> DataFrame:
    """Entries of the local lists: the k best of each in every batch, or those of at least the query's cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, query, part, score = _local(b, q, weight, lists)
            if k:
                order = np.lexsort((doc, -score, part, query))
                group = query[order] * lists + part[order]
                place = np.arange(len(order)) - np.searchsorted(group, group)
                keep = order[place < k]
            else:
                keep = np.flatnonzero(score >= cutoff[query]) if cutoff is not None else np.arange(len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(query[keep].astype(np.int32)), pa.array(part[keep].astype(np.int32)), pa.array(score[keep])], names=["doc_id", "query", "list", "score"])

    return found.mapInArrow(run, ENTRY)


def _bound(sums: DataFrame, k: int, size: int) -> np.ndarray:
    """The k-th best partial sum of each query, 0 where there are fewer."""
    ranked = sums.selectExpr("query", "seen", "row_number() OVER (PARTITION BY query ORDER BY seen DESC, doc_id) AS place").where(F.col("place") == k)
    out = np.zeros(size)
    for r in ranked.collect():  # one row a query of this pass
        out[r["query"]] = r["seen"]
    return out


RESULT = "item_id, place, doc_id, score"


def _search(docs: DataFrame, q: Queries, k: int, n: int, lists: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    # rows with one id become one document
    joined = F.aggregate(F.collect_list("grams"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("grams")
    found = checkpoint(matches(docs, q, n, id_col, text_col).groupBy("doc_id").agg(joined))
    total = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col).distinct().count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(q.grams), dtype=np.int64)
        for b in batches:
            _, g = _distinct(b)
            df += np.bincount(g, minlength=len(df))
        nz = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(nz.astype(np.int32)), pa.array(df[nz])], names=["gram", "df"])

    df = found.mapInArrow(count, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    weight = np.ones(len(q.grams))
    weight[df["gram"]] = np.maximum(1, np.round(1000 * np.log(total / df["df"].to_numpy())))
    # phase 1
    best = _entries(found, q, weight, lists, k=k).selectExpr("*", "row_number() OVER (PARTITION BY query, list ORDER BY score DESC, doc_id) AS place").where(F.col("place") <= k)
    low = _bound(best.groupBy("query", "doc_id").agg(F.sum("score").alias("seen")), k, len(q.ids))
    # phase 2
    cutoff = low / lists
    seen = checkpoint(_entries(found, q, weight, lists, cutoff=cutoff).groupBy("query", "doc_id").agg(F.sum("score").alias("seen"), F.count("*").alias("n")))
    low = _bound(seen, k, len(q.ids))
    limits = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(cutoff, low, strict=True))], "query int, cutoff double, low double")
    cand = checkpoint(seen.join(F.broadcast(limits), "query").where(F.col("seen") + (lists - F.col("n")) * F.col("cutoff") >= F.col("low")).select("query", "doc_id"))
    # phase 3
    some = cand.select("doc_id").distinct()
    exact = _entries(within(found, some, "doc_id"), q, weight, lists).groupBy("query", "doc_id").agg(F.sum("score").alias("score"))
    top = exact.join(cand, ["query", "doc_id"]).selectExpr("query", "doc_id", "score", "row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place").where(F.col("place") <= k)
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(q.ids)], "query int, item_id long")
    return top.join(F.broadcast(names), "query").selectExpr("item_id", "CAST(place AS BIGINT) AS place", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, n: int = N, lists: int = LISTS, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents of every query: (item_id, place, doc_id, score)."""
    asked = queries.where(F.col(query_id).isNotNull() & F.col(query_text).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.lower(query_text).alias("t")).orderBy("id")
    out: DataFrame | None = None
    passes: list[Queries] = []
    ids: list[int] = []
    texts: list[str] = []
    for r in asked.toLocalIterator():
        if len(ids) >= QUERIES and r["id"] != ids[-1]:
            passes.append(Queries(np.array(ids), pa.array(texts), n))
            ids, texts = [], []
        ids.append(r["id"])
        texts.append(r["t"])
    if ids:
        passes.append(Queries(np.array(ids), pa.array(texts), n))
    for q in passes:
        top = _search(docs, q, k, n, lists, id_col, text_col)
        out = top if out is None else out.unionByName(top)
    return docs.sparkSession.createDataFrame([], "item_id long, place long, doc_id long, score long") if out is None else out
