"""Passages that repeat across documents, by distributed prefix doubling.

A suffix is known by its place (document, word).  Two suffixes that agree over
``LENGTH`` words share a passage.

1. *Anchors.*  In every window of ``LENGTH`` words the least hash of 16 words
   is an anchor (winnowing): equal windows have equal anchors.  Only windows
   whose anchor occurs elsewhere can repeat; the others, provably unique, need
   no rank.
2. *Doubling.*  Remaining places start with the hash of their first 16 words as
   rank.  In each round Spark sorts the pairs (rank at a place, rank at an
   offset from it); equal neighbours in that order get one new rank, places
   whose pair is unique leave.  Offsets grow, 16 and then 18 for 50 words, so
   that a rank stands for 32 and then 50 words; past ``LENGTH`` words the
   doubling stops.  Places are kept in chunks of documents, packed: a chunk
   sends each distinct pair once, however many of its places have it, and gets
   the new ranks of those that stay, packed too: they come in the order of its
   pairs, so that differences of both are small.
3. *Runs.*  Adjoining places that are left and lead to the same partner form a
   passage.

Exact up to collisions of the hashes: two of 40 bits decide on 32 words.

Defined results: null, empty and shorter texts repeat nothing; null ids are
left out; a passage that repeats only inside one document, or in rows with the
same id, is no result, unless ``inside`` asks for those too, whose partner is
the document itself; of several partners the smallest other id is named; every
document of a repeat is listed, the first one too; rows with one id list their
passages each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import checkpoint, grouped, partitions, perhaps, removed, split_by, tidied, written

LENGTH = 50
ANCHOR = 16
CHUNK = 1 << 20
_MAX = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i:i+width] for every i where it fits, by doubling."""
    have, y = 1, x
    while have * 2 <= width:
        y = op(y[: len(y) - have], y[have:])
        have *= 2
    n = len(x) - width + 1
    return op(y[:n], y[width - have : width - have + n])


def anchors(h: np.ndarray, doc: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of ``length`` words that lie in one document."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if len(h) < length:
        return none
    x = tx.run_hashes(h, k)
    w = length - k + 1
    least = _sliding(x, w, np.minimum)  # one for each window of words
    inside = doc[: len(least)] == doc[length - 1 :]
    least = np.where(inside, least, 0)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    reach = _sliding(pad, w, np.maximum)[: len(x)]  # the greatest of the windows that hold this place
    at = np.flatnonzero((reach == x) & (reach > 0))
    return at, x[at]


def offsets(length: int, start: int) -> list[int]:
    """The offsets at which ranks are paired until they stand for ``length`` words."""
    out, have = [], start
    while have < length:
        out.append(min(have, length - have))
        have += out[-1]
    return out


def _ends(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By key (sorted): where it starts, its least and its next document (_MAX: none), its places and its documents, rows of one id in one chunk counting once."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    least = np.minimum.reduceat(doc, edge)
    other = np.minimum.reduceat(np.where(doc == np.repeat(least, size), _MAX, doc), edge)
    order = np.lexsort((doc, np.repeat(np.arange(len(edge)), size)))
    d = doc[order]
    new = np.concatenate([[True], d[1:] != d[:-1]])
    new[edge] = True
    return edge, least, other, size, np.add.reduceat(new.astype(np.int64), edge)


_HITS = "bucket int, hashes binary, docs binary, places binary, many binary, known binary"
_HIT_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "places", "many", "known"))])


def repeated_anchors(texts: DataFrame, length: int, k: int, inside: bool = False) -> DataFrame:
    """(doc_id, places): the anchors of each document that occur elsewhere too."""
    buckets = partitions(texts.sparkSession)
    m = np.uint64(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            x, d, p = (np.concatenate([y[i] for y in held]) for i in range(3))
            held.clear()
            order = np.argsort(x, kind="stable")
            x, d, p = x[order], d[order], p[order]
            edge, _, other, size, _ = _ends(x, d)
            many = (size > 1) if inside else (other != _MAX)
            each = np.repeat(many, size)
            # what repeats here is known, whatever others say; they are told once, and once of what does not
            alone = np.flatnonzero(~each)
            kinds = (np.uint32, np.int64, np.uint32, np.uint32)
            out: list[list] = [[] for _ in _HIT_SCHEMA]
            one, told = dict(split_by((x[alone] % m).astype(np.int64), buckets)), dict(split_by((x[edge[many]] % m).astype(np.int64), buckets))
            none = np.zeros(0, dtype=np.int64)
            for b in range(buckets):
                i, j = alone[one.get(b, none)], edge[many][told.get(b, none)]
                if len(i) or len(j):
                    for y, c in zip(out, (b, *(v.astype(t).tobytes() for v, t in zip((x[i] // m, d[i], p[i], x[j] // m), kinds, strict=True)), b""), strict=True):
                        y.append(c)
            known = np.flatnonzero(each)
            for y, c in zip(out, (int(x[0] % m), b"", d[known].astype(np.int64).tobytes(), p[known].astype(np.uint32).tobytes(), b"", b"1"), strict=True):
                y.append(c)
            return pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(out, _HIT_SCHEMA, strict=True)], schema=_HIT_SCHEMA)

        total = 0
        for ids, w, *_ in _frame(batches):
            at, x = anchors(w.hashes(), w.doc, length, k)
            doc = w.doc[at]
            held.append((x, ids[doc].astype(np.int64), at - w.first[doc]))
            total += len(at)
            if total >= CHUNK:
                yield flush()
                total = 0
        if total:
            yield flush()
        tx.release()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}

        def rows(d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(p.astype(np.int32))], names=["doc_id", "place"])

        for b in batches:
            for k, x, d, p, y, known in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if known:
                    yield rows(np.frombuffer(d, np.int64), np.frombuffer(p, np.uint32))
                else:
                    kept.setdefault(k, []).append((x, d, p, y))
        for k in list(kept):
            xs = kept.pop(k)
            x, d, p, told = (np.frombuffer(b"".join(r[i] for r in xs), t) for i, t in enumerate((np.uint32, np.int64, np.uint32, np.uint32)))
            if not len(x):
                continue
            order = np.argsort(x, kind="stable")
            x, d, p = x[order], d[order], p[order]
            edge, _, other, size, _ = _ends(x, d)
            keep = np.repeat((size > 1) if inside else (other != _MAX), size) | np.isin(x, told)
            yield rows(d[keep], p[keep])
        tx.release()

    found = texts.mapInArrow(send, _HITS).repartition(buckets, "bucket").mapInArrow(receive, "doc_id long, place int")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _frame(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tx.Words, pa.RecordBatch, int, int]]:
    for b in batches:
        ids = tx.column(b, "doc_id").to_numpy(zero_copy_only=False)
        for i, j in tx.slices(tx.column(b, "t")):
            yield ids[i:j], tx.words(*tx.raw(tx.column(b, "t").slice(i, j - i))), b, i, j


#: A chunk of documents: their ids and, by place, the row of its document, its word and its first pair of ranks.
STATE = "chunk long, docs binary, rows binary, words binary, a binary, b binary"
_STATE_SCHEMA = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("docs", "rows", "words", "a", "b"))])


def chunks(texts: DataFrame, length: int, k: int, steps: list[int]) -> DataFrame:
    """The places that windows with a repeated anchor need ranks of, with pairs of ranks at the first offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, w, b, i, j in _frame(batches):
            h = w.hashes()
            if len(h) < length:
                continue
            lists = tx.column(b, "places").slice(i, j - i)
            where = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
            fits = where + k <= w.counts[row]  # another row with this id may be longer
            where, row = where[fits], row[fits]
            # windows that hold a repeated anchor: a difference array over the slice's words
            at = w.first[row] + where
            diff = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(diff, np.maximum(at - (length - k), w.first[row]), 1)
            np.add.at(diff, at + 1, -1)
            n = len(h) - length + 1
            need = np.zeros(len(h), dtype=bool)
            need[:n] = (np.cumsum(diff)[:n] > 0) & (w.doc[:n] == w.doc[length - 1 :])
            for o in steps[:0:-1]:  # a rank is made of ranks here and at the offset
                need[o:] |= need[:-o]
            p = np.flatnonzero(need)
            if not len(p):
                continue
            g = tx.run_hashes(h, k) >> np.uint64(24 if steps else 0)  # two of 40 bits make a pair
            second = g[p + steps[0]] if steps else np.zeros(len(p), np.uint64)
            doc = w.doc[p]
            yield _packed(number, ids.astype(np.int64), doc, p - w.first[doc], g[p], second)
            number += 1

    return texts.mapInArrow(run, STATE)


def _packed(chunk: int, docs: np.ndarray, row: np.ndarray, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A chunk's row; rows and words as differences, nearly all 0 and 1, which compress to nothing."""
    cols = (docs, np.diff(row, prepend=0).astype(np.int32), np.diff(word, prepend=0).astype(np.int32), a, b)
    return pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], schema=_STATE_SCHEMA)


def _chunk(row: dict) -> tuple[np.ndarray, ...]:
    docs, rows, words, a, b = (np.frombuffer(row[c], t) for c, t in (("docs", np.int64), ("rows", np.int32), ("words", np.int32), ("a", np.uint64), ("b", np.uint64)))
    return docs, np.cumsum(rows, dtype=np.int64), np.cumsum(words, dtype=np.int64), a, b


PAIRS = "a long, b long, chunk long, item int, least long, counts long"
#: The replies to a chunk from some run of sorted pairs, packed: its items, as differences, and what is said of each.
REPLIES = "chunk long, items binary, ranks binary, least binary, other binary, n binary"
_REPLY_SCHEMA = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("items", "ranks", "least", "other", "n"))])


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs, and a number of each pair in that order."""
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    return order, np.cumsum(new)


def sorted_pairs(state: DataFrame, last: bool) -> DataFrame:
    """Each chunk's distinct pairs, sorted by Spark over all chunks; a second document is told only in the last round, how many there are in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, row, _, a, b = _chunk(r)
                if not len(a):
                    continue
                order, group = _groups(a, b)
                edge, least, other, times, n = _ends(group, docs[row[order]])
                first = order[edge]
                cols = [a[first].view(np.int64), b[first].view(np.int64), np.full(len(edge), r["chunk"]), np.arange(len(edge), dtype=np.int32), least, n << 32 | times]
                names = ["a", "b", "chunk", "item", "least", "counts"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *([pa.array(other)] if last else [])], names=[*names, *(["other"] if last else [])])

    pairs = state.mapInArrow(run, PAIRS + ", other long" * last)
    return pairs.repartitionByRange(partitions(state.sparkSession), "a", "b").sortWithinPartitions("a", "b")


def reranked(pairs: DataFrame, inside: bool, last: bool) -> DataFrame:
    """New ranks, in the order of the sorted pairs, of those that are not unique; in the last round instead the two least documents that have the pair and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            chunk, item, *said = (np.concatenate([x[k] for x in held]) for k in range(len(held[0])))
            held.clear()
            order = np.argsort(chunk, kind="stable")
            chunk, item, said = chunk[order], item[order], [x[order] for x in said]
            edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            parts = list(zip(edge, np.append(edge[1:], len(chunk)), strict=True))
            gaps = lambda x, t: [np.diff(x[i:j], prepend=0).astype(t).tobytes() for i, j in parts]
            none = [b""] * len(parts)
            told = [none, *([x[i:j].astype(np.int64).tobytes() for i, j in parts] for x in said)] if last else [gaps(said[0], np.int64), none, none, none]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((chunk[edge], gaps(item, np.int32), *told), _REPLY_SCHEMA, strict=True)], schema=_REPLY_SCHEMA)

        for part in _whole_runs(batches):
            a, b, chunk, item, least, counts = (part.column(i).to_numpy() for i in range(6))
            n, times = counts >> 32, counts & 0xFFFFFFFF
            edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            size = np.diff(np.append(edge, len(a)))
            first = np.minimum.reduceat(least, edge)
            several = (np.maximum.reduceat(n, edge) > 1) | (np.maximum.reduceat(least, edge) != first)
            keep = np.add.reduceat(times, edge) > 1 if inside else several
            if last:
                # the next one: the least of all documents but the first
                rest = np.where(least == np.repeat(first, size), part.column(6).to_numpy(), least)
                said = (first, np.minimum.reduceat(rest, edge), np.add.reduceat(n, edge))
            else:
                said = (rank + 1 + np.arange(len(edge)),)
            rank += len(edge)
            each = np.repeat(keep, size)
            if each.any():
                held.append((chunk[each], item[each], *(np.repeat(x, size)[each] for x in said)))
                total += len(held[-1][0])
                if total >= CHUNK:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    return pairs.mapInArrow(run, REPLIES)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches joined so that no run of equal pairs is cut: a run has a row a chunk at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        a, c = (b.column(i).to_numpy() for i in range(2))
        cut = np.flatnonzero((a != a[-1]) | (c != c[-1]))
        at = int(cut[-1]) + 1 if len(cut) else 0
        if at == 0 and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (a[0], c[0]):
            yield pa.Table.from_batches(held)
            held = []
        if at:
            held.append(b.slice(0, at))
            yield pa.Table.from_batches(held)
            held = [b.slice(at)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


_NUMBERED = "chunk long, docs binary, rows binary, words binary, items binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the number of the pair at each place in place of the pair itself."""
    for batch in batches:
        for r in batch.to_pylist():
            *_, a, b = _chunk(r)
            order, group = _groups(a, b)
            number = np.empty(len(a), dtype=np.int32)
            number[order] = group
            blob = pa.compress(number.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]]), *(pa.array([x], pa.binary()) for x in (r["docs"], r["rows"], r["words"], blob))], names=["chunk", "docs", "rows", "words", "items"])


def _answered(state: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks next to the replies to them, sorted by chunk, the chunk itself first."""
    none = lambda *cols: [F.lit(None).cast("binary").alias(c) for c in cols]
    s = state.mapInArrow(_numbered, _NUMBERED).select("chunk", F.lit(0).alias("reply"), "docs", "rows", "words", "items", *none("ranks", "least", "other", "n"))
    r = replies.select("chunk", F.lit(1).alias("reply"), *none("docs", "rows", "words"), "items", "ranks", "least", "other", "n")
    return s.unionByName(r).repartition(partitions(state.sparkSession), "chunk").sortWithinPartitions("chunk", "reply")


def _placed(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray, list[np.ndarray]]]:
    """(chunk, its arrays, the places that stay, what was replied to each)."""
    for (chunk,), t in grouped(batches, ["chunk"]):
        own = {c: t[c][0].as_py() for c in ("docs", "rows", "words", "items")}
        docs, row, word, *_ = _chunk(own | {"a": b"", "b": b""})
        number = np.frombuffer(pa.decompress(own["items"], decompressed_size=len(own["rows"]), codec="zstd", asbytes=True), np.int32)
        blobs = t.slice(1).to_pylist()
        read = lambda c, f, blobs=blobs: np.concatenate([np.zeros(0, np.int64), *(f(r[c]) for r in blobs)])
        plain = lambda x: np.frombuffer(x, np.int64)
        item = read("items", lambda x: np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64))
        of = np.full(int(number.max()) + 1, -1, dtype=np.int64)
        of[item] = np.arange(len(item))
        at = of[number]
        keep = np.flatnonzero(at >= 0)
        said = [read(c, plain) for c in ("least", "other", "n")] if last else [read("ranks", lambda x: np.cumsum(plain(x)))]
        yield chunk, (docs, row, word), keep, [x[at[keep]] for x in said]


def advanced(state: DataFrame, replies: DataFrame, offset: int) -> DataFrame:
    """Chunks with pairs of the new ranks at the next offset; places without both ranks leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, (docs, row, word), keep, (rank,) in _placed(batches, False):
            at = row[keep] << 32 | word[keep]  # sorted
            p = np.searchsorted(at, at + offset)
            both = p < len(at)
            both[both] = at[p[both]] == at[both] + offset
            i, j = np.flatnonzero(both), p[both]
            if len(i):
                yield _packed(chunk, docs, row[keep][i], word[keep][i], rank[i].astype(np.uint64), rank[j].astype(np.uint64))
        tx.release()

    return _answered(state, replies).mapInArrow(run, STATE)


RESULT = "doc_id long, start_word long, n_words long, other_doc long, n_docs long"


def _runs(state: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (docs, row, word), keep, (least, second, n) in _placed(batches, True):
            row, place = row[keep], word[keep]
            if not len(row):
                continue
            doc = docs[row]
            other = np.where(doc != least, least, np.where(second == _MAX, doc, second))
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (other[1:] != other[:-1])])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at]), pa.array(place[at]), pa.array(place[last] - place[at] + length), pa.array(other[at]), pa.array(np.maximum.reduceat(n, at))],
                names=["doc_id", "start_word", "n_words", "other_doc", "n_docs"],
            )
        tx.release()

    return _answered(state, replies).mapInArrow(run, RESULT)


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", inside: bool = False) -> DataFrame:
    """Passages of at least ``length`` words that another document has too: where they are, one such document, and how many documents have the most repeated part."""
    k = min(ANCHOR, max(1, length // 3))
    steps = offsets(length, k)
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t"))
    hits = checkpoint(repeated_anchors(d, length, k, inside))
    state = written(chunks(perhaps(d, hits, "doc_id").join(hits, "doc_id"), length, k, steps), "chunks")
    del hits
    tidied(docs.sparkSession)  # what found the anchors is not needed again
    for i in range(max(1, len(steps))):
        last = i + 1 >= len(steps)
        replies = reranked(sorted_pairs(state, last), inside, last)
        if last:
            return _runs(state, replies, length)
        before, state = state, written(advanced(state, replies, steps[i + 1]), "chunks")
        removed(before)
        tidied(docs.sparkSession)
    raise AssertionError
