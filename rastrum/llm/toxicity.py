"""Document toxicity from an induced lexicon.

1. *Vocabulary.*  Document frequencies of all words over all documents.  Nodes
   of a word graph are all words that the labels mark as toxic (see 2),
   whatever their share of the documents, and other words of at least
   ``MIN_SHARE`` of the documents (and ``MIN_DOCS``) and at most ``MAX_SHARE``.
   The shares bound the number of other nodes, however large the corpus; that
   of marked words is bounded by the labelled texts.
2. *Seeds.*  Labelled terms: words whose labelled documents are toxic
   far beyond chance, by the z-score of the smoothed log-odds, and those
   whose documents are not.  Copies of a text count once.
3. *Graph.*  Words within ``WINDOW`` words of each other, in all documents, are
   joined by their positive pointwise mutual information.
4. *Walks.*  Random walks with restart from the toxic and from the other seeds;
   a word's polarity is the share of the toxic walk in both, from -1 to 1.
5. *Scores.*  A document's score is the sum of the polarities of its words
   from a level on, a repeated word counting again, over the square root of
   its length.  Level (one of ``LEVELS``) and cut are those that best tell the
   labelled documents apart.

Defined results: null, empty and word-less texts score 0 and are not toxic; a
document that is labelled more than once is toxic if any label says so, null
labels count as none; repeated rows are scored independently; equal cuts go to
the greater; without toxic labels there are no seeds, so that nothing is
toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import checkpoint, maybe, pack, partitions, perhaps, split_by, tidied, unpack

MIN_SHARE = 1e-3
MIN_DOCS = 5
MAX_SHARE = 0.05
WINDOW = 8
SEED_Z = 3.3
RESTART = 0.3
STEPS = 12
#: Polarities from which a word may count as in the lexicon; labelled documents decide.
LEVELS = (0.98, 0.95, 0.9, 0.8, 0.6)
CHUNK = 2 << 20
#: Ranges of the vocabulary by which a word's co-occurrences are spread over buckets.
PIECES = 32
#: Numbers of a vector that are added up together.
SLICE = 1 << 15


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t"))


def _least_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's least trigram hash, which its copies mostly share."""
    for b in batches:
        for i, j in tx.slices(tx.column(b, "t")):
            w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
            g, at = tx.ngram_hashes(w, 3)
            some = np.flatnonzero(w.counts)
            least = np.minimum.reduceat(g, np.searchsorted(at, w.first[some])) if len(some) else np.zeros(0, np.uint64)
            rows = pa.array(some)
            yield pa.RecordBatch.from_arrays([tx.column(b, "doc_id").slice(i, j - i).take(rows), pa.array(least.view(np.int64))], names=["doc_id", "h"])


def vocabulary(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, df, toxic, clean): by word hash, in how many documents, toxic and other labelled ones it occurs."""
    # only texts that may have a label are sent to theirs
    split = maybe(texts, labels, "doc_id")
    marked = split.where("__in").join(labels, "doc_id", "left").select("t", "toxic")
    marked = marked.unionByName(split.where("NOT __in").select("t", F.lit(None).cast("int").alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate(parts)
            word, back = np.unique(rows[:, 0], return_inverse=True)
            return word, np.stack([np.bincount(back, rows[:, i].astype(np.float64), len(word)) for i in (1, 2, 3)], axis=1)

        for b in batches:
            label = tx.column(b, "toxic").fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                h = w.hashes()
                order = np.lexsort((h, w.doc))
                h, d = h[order], w.doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, x = h[new], label[i:j][d[new]]
                word, back = np.unique(h, return_inverse=True)
                parts.append(np.stack([word, *(np.bincount(back, m, len(word)).astype(np.uint64) for m in (np.ones(len(h)), x == 1, x == 0))], axis=1))
            if sum(map(len, parts)) > CHUNK:
                word, n = merged()
                parts = [np.column_stack([word, n.astype(np.uint64)])]
                if len(word) > CHUNK // 2:
                    yield _counts(word, n)
                    parts = []
        if parts:
            yield _counts(*merged())

    def _counts(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(n[:, i].astype(np.int64)) for i in range(3))], names=["word", "df", "toxic", "clean"])

    found = marked.mapInArrow(run, "word long, df long, toxic long, clean long")
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("df", "toxic", "clean")))


def _lookup(words: np.ndarray):
    """A function from hashes to (places, index in the sorted words) of those among them."""
    near = np.zeros(1 << 20, dtype=bool)
    near[(words >> np.uint64(44)).astype(np.int64)] = True

    def of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(near[(h >> np.uint64(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(words, h[maybe]), max(0, len(words) - 1))
        hit = words[p] == h[maybe] if len(words) else np.zeros(0, bool)
        return maybe[hit], p[hit]

    return of


def cooccurrence(texts: DataFrame, words: np.ndarray, window: int) -> DataFrame:
    """(pairs, counts), packed by partition: how often two words of the vocabulary lie within ``window`` words, be it once; _pairs() has them as i < j and n."""
    v, buckets = len(words), partitions(texts.sparkSession)
    of = _lookup(words)
    schema = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            out: list[list] = [[], [], []]
            # neighbours of a word share a bucket, but for PIECES ranges of them: keys of a bucket are close to each other
            i = key // np.uint64(v)
            place = i * np.uint64(PIECES) + (key - i * np.uint64(v)) * np.uint64(PIECES) // np.uint64(v)
            for k, at in split_by((tx.mix64(place) % np.uint64(buckets)).astype(np.int64), buckets):
                # sorted keys as differences, mostly small, and counts, mostly 1
                for x, y in zip(out, (k, pack(np.diff(key[at], prepend=np.uint64(0))), pack(n[at].astype(np.uint32))), strict=True):
                    x.append(y)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        for b in batches:
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                at, word = of(w.hashes())
                doc = w.doc[at]
                for d in range(1, window + 1):
                    near = np.flatnonzero((at[d:] - at[:-d] <= window) & (doc[d:] == doc[:-d])) if len(at) > d else np.zeros(0, np.int64)
                    if not len(near):
                        break
                    x, y = word[near], word[near + d]
                    differ = x != y
                    held.append((np.minimum(x, y) * v + np.maximum(x, y))[differ].astype(np.uint64))
                if sum(map(len, held)) > CHUNK:
                    yield flush()
        if held:
            yield flush()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not xs:
            return
        key = np.concatenate([np.cumsum(unpack(x[0], np.uint64), dtype=np.uint64) for x in xs])
        n = np.concatenate([unpack(x[1], np.uint32) for x in xs])
        del xs
        order = np.argsort(key)
        key, n = key[order], n[order]
        del order
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(n, edge, dtype=np.int64)
        packed = (pack(np.diff(key[edge], prepend=np.uint64(0))), pack(total))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["pairs", "counts"])
        del key, n, edge, total
        tx.release()

    return texts.select("t").mapInArrow(send, "bucket int, pairs binary, counts binary").repartition(buckets, "bucket").mapInArrow(receive, "pairs binary, counts binary")


def _pairs(pairs: bytes, counts: bytes, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n) of one packed row of co-occurrences in a vocabulary of v words."""
    key = np.cumsum(unpack(pairs, np.uint64), dtype=np.uint64)
    i = key // np.uint64(v)
    return i.astype(np.int64), (key - i * np.uint64(v)).astype(np.int64), unpack(counts, np.int64)


def polarities(edges: DataFrame, v: int, toxic: np.ndarray, clean: np.ndarray, restart: float, steps: int) -> np.ndarray:
    """The polarity of each word by two random walks with restart over positive pointwise mutual information of all pairs.

    Edges stay spread over the cluster.  Each task sums its own into a vector, vectors are added up by slices on
    executors, and each step sends the driver one vector of the vocabulary's size.
    """

    def summed(df: DataFrame, f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                for xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total = total + f(*_pairs(*xs, v))
            if not isinstance(total, int):
                at = range(0, len(total), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE for k in at], pa.int32()), pa.array([total[k : k + SLICE].tobytes() for k in at], pa.binary())], names=["k", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "x"])

        parts = df.select("pairs", "counts").mapInArrow(run, "k int, x binary").repartition(-(-2 * v // SLICE), "k").mapInArrow(add, "k int, x binary").collect()
        return np.concatenate([np.frombuffer(r["x"]) for r in sorted(parts)]) if parts else np.zeros(v)

    def both(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bincount(i, x, v) + np.bincount(j, y, v)

    mass = summed(edges, lambda i, j, n: both(i, j, n, n))
    all_ = mass.sum()

    def weight(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.log(n * all_ / (mass[i] * mass[j])))

    degree = summed(edges, lambda i, j, n: both(i, j, weight(i, j, n), weight(i, j, n)))
    inverse = np.divide(1, degree, out=np.zeros(v), where=degree > 0)
    start = np.stack([np.bincount(s, minlength=v) / max(1, len(s)) for s in (toxic, clean)])
    p = start.copy()
    for _ in range(steps):
        q = p * inverse

        def step(i: np.ndarray, j: np.ndarray, n: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            w = weight(i, j, n)
            return np.concatenate([both(i, j, w * x[j], w * x[i]) for x in q])

        moved = summed(edges, step)
        moved = moved.reshape(2, v) if len(moved) == 2 * v else np.zeros((2, v))
        p = restart * start + (1 - restart) * moved
    total = p.sum(axis=0)
    return np.divide(p[0] - p[1], total, out=np.zeros(v), where=total > 0)


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    cut: float


def _scored(w: tx.Words, of, weights: np.ndarray, docs: int, level: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Scores and counts of lexicon terms of a slice's documents."""
    at, k = of(w.hashes())
    doc, x = w.doc[at], weights[k] if len(weights) else np.zeros(0)
    doc, x = doc[x >= level], x[x >= level]
    return np.round(np.bincount(doc, x, docs) / np.sqrt(np.maximum(1, w.counts)), 4), np.bincount(doc, minlength=docs)


def _level_scores(labelled: DataFrame, words: np.ndarray, p: np.ndarray) -> DataFrame:
    """(level, score, t, c): how many toxic and other labelled documents have a score above 0 at each level."""
    keep = np.flatnonzero(p >= min(LEVELS))
    of, weights = _lookup(words[keep]), p[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = tx.column(b, "toxic").to_numpy(zero_copy_only=False)
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                for level in LEVELS:
                    score, _ = _scored(w, of, weights, j - i, level)
                    some = np.flatnonzero(score > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), level)), pa.array(score[some]), pa.array(label[i:j][some].astype(np.int32))], names=["level", "score", "toxic"])

    found = labelled.select("t", "toxic").mapInArrow(run, "level double, score double, toxic int")
    return found.groupBy("level", "score").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, terms) of every document: its score and how many of its words are in the lexicon."""
    of, weights = _lookup(lexicon.words), lexicon.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = tx.column(b, "doc_id")
            for i, j in tx.slices(tx.column(b, "t")):
                w = tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i)))
                score, terms = _scored(w, of, weights, j - i)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(score), pa.array(terms.astype(np.int64))], names=["doc_id", "score", "terms"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, terms long")


def induce(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> Lexicon:
    """The lexicon of a corpus, some of whose documents are labelled."""
    texts = _texts(docs, id_col, text_col)
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    # copies of a text speak once: of texts with the same least trigram only the least labelled id keeps its label
    least = perhaps(texts, lab, "doc_id").mapInArrow(_least_grams, "doc_id long, h long")
    first = least.join(lab, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("x")).select("x.doc_id", "x.toxic")
    first = checkpoint(first.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = docs.count()
    said = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    bound = max(min_docs, min_share * n)
    nt, nc = said.get(1, 0), said.get(0, 0)
    base = nt / max(1, nt + nc)
    # words marked by labels stay whatever their share; the others are bounded by words a document over min_share, whatever the size of the corpus
    marked_ = f"""toxic / greatest(1, toxic + clean) >= {(1 + base) / 2!r}D AND
        (ln((toxic + 0.5D) / {nt + 1}) - ln((clean + 0.5D) / {nc + 1})) / sqrt(1 / (toxic + 0.5D) + 1 / (clean + 0.5D)) >= {SEED_Z!r}D"""
    pdf = vocabulary(texts, first).where((F.col("df") >= bound) & (F.col("df") <= max_share * max(n, 20 * min_docs)) | F.expr(marked_)).toPandas()
    words = pdf["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    t, c = (pdf[k].to_numpy(dtype=np.float64)[order] for k in ("toxic", "clean"))
    odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    z = odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    strong = np.flatnonzero((z >= SEED_Z) & (t / np.maximum(1, t + c) >= (1 + base) / 2))
    toxic = strong
    clean = np.flatnonzero((c > 0) & (t / np.maximum(1, t + c) < (1 + base) / 2))
    if not len(toxic) or not len(clean):
        return Lexicon(words[:0], np.zeros(0), np.inf)
    tidied(docs.sparkSession)  # shuffles of labelled texts and words go before the graph's
    edges = checkpoint(cooccurrence(texts, words, WINDOW))
    tidied(docs.sparkSession)
    p = polarities(edges, len(words), toxic, clean, RESTART, STEPS)
    # of a few polarities to start the lexicon at, the one that tells labelled documents apart best, and its cut
    held = _level_scores(perhaps(texts, first, "doc_id").join(first, "doc_id"), words, p).toPandas()
    best, least = Lexicon(words[:0], np.zeros(0), np.inf), 0.0
    for level in LEVELS:
        own = held[held["level"] == level].sort_values("score", ascending=False)
        if len(own):
            tp, fp = own["t"].cumsum().to_numpy(dtype=np.float64), own["c"].cumsum().to_numpy(dtype=np.float64)
            f1 = 2 * tp / (tp + fp + nt)
            k = int(np.argmax(f1))
            if f1[k] > least:
                keep = np.flatnonzero(p >= level)
                best, least = Lexicon(words[keep], p[keep], float(own["score"].to_numpy()[k])), float(f1[k])
    return best


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, score, terms) of the documents whose score reaches the lexicon's cut."""
    lex = induce(docs, labels, id_col, text_col, label_col)
    return scores(docs, lex, id_col, text_col).where(F.col("score") >= F.lit(lex.cut))
