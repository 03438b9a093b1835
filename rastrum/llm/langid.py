"""Language identification of mixed-language text.

The script of a word (by the Unicode range of its first letter) narrows the
candidate languages; each word gets a log-likelihood under every candidate
from byte trigrams; a Viterbi pass over the words of a document, in which
leaving a language costs ``switch_penalty``, labels spans.

The trigram model is fitted on a bounded sample of labelled rows
(``sample_rows``, chosen by a hash of the id); every document is then labelled
over its whole text.

Defined results: null, empty or word-less text gives one span ``und`` of 0
words and is rejected; words without a letter take the language around them;
a document scoring below the floor seen in training is ``und`` and rejected;
ties go to the language first in alphabetical order; repeated rows are
labelled independently; an empty table gives no rows; without any labelled row
only scripts decide.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

SWITCH_PENALTY = 12.0
SAMPLE_ROWS = 4000
#: A mean over n letters may lie so much over sqrt(n) below the floor.
SLACK = 20.0
_BITS = 16
_SLICE = 3 << 20
_NEVER = np.float32(-60.0)

SCRIPTS = ["none", "Latn", "Grek", "Cyrl", "Armn", "Hebr", "Arab", "Deva", "Thai", "Geor", "Kana", "Hani", "Hang", "Zzzz"]
#: What a script says by itself when no trained language is written in it.
ALONE = {"Grek": "el", "Cyrl": "und-Cyrl", "Armn": "hy", "Hebr": "he", "Arab": "und-Arab", "Deva": "und-Deva", "Thai": "th", "Geor": "ka", "Kana": "ja", "Hani": "zh", "Hang": "ko", "Zzzz": "und-Zzzz"}
_S = {s: i for i, s in enumerate(SCRIPTS)}


def _script_table() -> np.ndarray:
    t = np.full(65536, _S["Zzzz"], dtype=np.uint8)

    def put(lead: range, script: str, second: range = range(256)) -> None:
        for a in lead:
            for b in second:
                t[a << 8 | b] = _S[script]

    put(range(0x00, 0x80), "none")
    put(range(ord("a"), ord("z") + 1), "Latn")
    put(range(ord("A"), ord("Z") + 1), "Latn")
    put(range(0x80, 0xC0), "none")
    put(range(0xC2, 0xCD), "Latn")
    put(range(0xCD, 0xD0), "Grek")
    put(range(0xD0, 0xD4), "Cyrl")
    put(range(0xD4, 0xD6), "Armn")
    put(range(0xD6, 0xD8), "Hebr")
    put(range(0xD8, 0xDE), "Arab")
    put(range(0xE0, 0xE1), "Deva", range(0xA4, 0xA6))
    put(range(0xE0, 0xE1), "Thai", range(0xB8, 0xBA))
    put(range(0xE1, 0xE2), "Geor", range(0x82, 0x84))
    put(range(0xE1, 0xE2), "Latn", range(0xB8, 0xBC))
    put(range(0xE1, 0xE2), "Grek", range(0xBC, 0xC0))
    put(range(0xE3, 0xE4), "Kana", range(0x81, 0x84))
    put(range(0xE3, 0xE4), "Hani", range(0x90, 0xC0))
    put(range(0xE4, 0xEA), "Hani")
    put(range(0xEA, 0xEE), "Hang")
    return t


_TABLE = _script_table()


def word_scripts(w: tx.Words) -> np.ndarray:
    """The script of each word's first letter; none for a word with a digit, which says nothing of its language."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint8)
    b = w.buf
    nxt = b[np.minimum(w.start + 1, len(b) - 1)]
    script = _TABLE[b[w.start].astype(np.uint16) << 8 | nxt]
    digit = (b >= 48) & (b <= 57)
    script[np.add.reduceat(digit.astype(np.int32), w.start) > 0] = 0
    return script


def trigram_codes(buf: np.ndarray, is_word: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A code for each byte from it and its neighbours in the same word; 0 outside words."""
    c = np.where(is_word, buf, 0).astype(np.uint32)
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    inner = cut[(cut > 0) & (cut < len(buf))]
    before[inner] = 0
    after[inner - 1] = 0
    code = (before * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.where(is_word, code >> np.uint32(32 - _BITS), 0).astype(np.uint16)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [language, code] log-probabilities
    scripts: np.ndarray  # [script, language] whether a candidate
    floor: float
    states: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.states = [*self.languages, *ALONE.values(), "und"]

    def label(self, buf: np.ndarray, offsets: np.ndarray, penalty: float) -> tuple[tx.Words, np.ndarray, np.ndarray]:
        """The words, the state of each and, by document, the mean log-likelihood of a byte under the chosen states."""
        is_word = tx.word_bytes(buf)
        w = tx.words(buf, offsets, is_word)
        n, k = len(w.start), len(self.languages)
        docs = len(offsets) - 1
        mean = np.zeros(docs)
        if not n:
            return w, np.zeros(0, dtype=np.uint8), mean
        script = word_scripts(w)
        alone = [i for i, s in enumerate(ALONE) if (script == _S[s]).any()]
        score = np.zeros((n, k + len(alone) + (k == 0)), dtype=np.float32)  # without a trained language the rest is und
        if k:
            code = trigram_codes(buf, is_word, offsets)
            for j in range(k):
                v = self.table[j][code]
                v[~is_word] = 0
                score[:, j] = np.add.reduceat(v, w.start)
            named = script > 0
            score[:, :k][~named] = 0
            score[:, :k][named & ~self.scripts[script].any(axis=1)] = _NEVER
            off = ~self.scripts[script] & self.scripts[script].any(axis=1)[:, None]
            score[:, :k] = np.where(off, np.minimum(score[:, :k], _NEVER), score[:, :k])
        names = list(ALONE)
        for c, i in enumerate(alone):
            own = script == _S[names[i]]
            known = self.scripts[_S[names[i]]].any() if k else False
            score[:, k + c] = np.where(own & (not known), 0, np.where(script == 0, 0, _NEVER * 2))
        lab = viterbi(score, w.first, penalty)
        length = (w.end - w.start) * (script > 0)
        got = np.where(lab < k, score[np.arange(n), lab], 0) * (script > 0)
        mean = np.bincount(w.doc, got, docs) / np.maximum(1, np.bincount(w.doc, length, docs))
        back = np.array([*range(k), *(k + i for i in alone), len(self.states) - 1], dtype=np.uint8)
        return w, back[lab], mean


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best state path of each document, all documents in step: V_t(l) = s_t(l) + max(V_{t-1}(l), max V_{t-1} - penalty)."""
    n, k = score.shape
    lab = np.zeros(n, dtype=np.uint8)
    if k < 2 or not n:
        return lab
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    at, count = first[:-1][order], count[order]
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    back = np.empty((n, k), dtype=np.uint8)
    own = np.arange(k, dtype=np.uint8)[None, :]
    v = np.zeros((len(order), k), dtype=np.float64)
    for t in range(len(live)):
        a = live[t]
        p, i = v[:a], at[:a] + t
        if t:
            best = p.argmax(axis=1)
            top = p[np.arange(a), best][:, None] - penalty
            stay = p >= top
            back[i] = np.where(stay, own, best[:, None])
            p = np.where(stay, p, top)
        v[:a] = p + score[i]
    state = v.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        a = live[t]
        i = at[:a] + t
        lab[i] = state[:a]
        if t:
            state[:a] = back[i, state[:a]]
    return lab


def train(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Trigram counts by language over at most ``sample_rows`` labelled rows, those of least id hash."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(label).alias("lang"), F.col(text_col).alias("t"))
    few = d.where("lang IS NOT NULL AND id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = spark.createDataFrame([(r[0],) for r in few.collect()], few.schema)
    sample = d.where("lang IS NOT NULL").join(F.broadcast(chosen), "id", "left_semi").select("lang", F.lower("t").alias("t"))
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = tx.column(b, "lang").to_pylist()
            for i, j in tx.slices(tx.column(b, "t")):
                buf, off = tx.raw(tx.column(b, "t").slice(i, j - i))
                is_word = tx.word_bytes(buf)
                w = tx.words(buf, off, is_word)
                code, scripts = trigram_codes(buf, is_word, off), word_scripts(w)
                for r in range(j - i):
                    x = total.setdefault(langs[i + r], (np.zeros(1 << _BITS, dtype=np.int64), np.zeros(len(SCRIPTS), dtype=np.int64)))
                    s = slice(off[r], off[r + 1])
                    np.add(x[0], np.bincount(code[s][is_word[s]], minlength=1 << _BITS), out=x[0])
                    np.add(x[1], np.bincount(scripts[w.first[r] : w.first[r + 1]], minlength=len(SCRIPTS)), out=x[1])
        for lang, xs in total.items():
            for kind, x in enumerate(xs):
                nz = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(nz), pa.string()), pa.array(np.full(len(nz), kind, np.int32)), pa.array(nz.astype(np.int32)), pa.array(x[nz])], schema=schema)

    rows = sample.mapInArrow(count, "lang string, kind int, code int, n long").groupBy("lang", "kind", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    grams = np.full((len(langs), 1 << _BITS), 0.3)
    seen = np.zeros((len(SCRIPTS), len(langs)))
    for j, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        g, s = own[own["kind"] == 0], own[own["kind"] == 1]
        grams[j, g["code"]] += g["n"]
        seen[s["code"], j] = s["n"]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32) if langs else np.zeros((0, 1 << _BITS), np.float32)
    seen[0] = 0
    cand = seen >= 0.01 * np.maximum(1, seen.sum(axis=0, keepdims=True))
    # the floor lies well below what a byte of training text costs on average
    cost = [float((own["n"] * table[j, own["code"]]).sum() / own["n"].sum()) for j, lang in enumerate(langs) if len(own := rows[(rows["lang"] == lang) & (rows["kind"] == 0)])]
    floor = min(cost, default=0.0) * 1.35 - 1.0
    return LanguageModel(langs, table, cand, floor)


SPANS = "doc_id long, span int, lang string, start_word long, n_words long, doc_lang string, accepted boolean"
_SPANS = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("lang", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("doc_lang", pa.string()), ("accepted", pa.bool_())])


def _document_languages(m: LanguageModel, w: tx.Words, lab: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state with most words in each document (ties: the first) and whether the document is accepted."""
    docs = len(w.first) - 1
    tally = np.zeros((docs, len(m.states)), dtype=np.int64)
    if len(lab):
        np.add.at(tally, (w.doc, lab), 1)
    best = tally.argmax(axis=1)
    letters = np.bincount(w.doc, (w.end - w.start) * (word_scripts(w) > 0), docs) if len(lab) else np.zeros(docs)
    ok = (letters > 0) & (best < len(m.languages)) & (mean >= m.floor - SLACK / np.sqrt(np.maximum(letters, 1)))
    return best, ok


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row for each span of each document: its language, first word and length, and the document's verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, und = np.array(model.states, dtype=object), len(model.states) - 1
        for b in batches:
            ids = tx.column(b, "doc_id")
            for i, j in tx.slices(tx.column(b, "t"), _SLICE):
                buf, off = tx.raw(tx.column(b, "t").slice(i, j - i))
                w, lab, mean = model.label(buf, off, penalty)
                best, ok = _document_languages(model, w, lab, mean)
                n = len(lab)
                begin = np.ones(n, dtype=bool)
                begin[1:] = (lab[1:] != lab[:-1]) | (w.doc[1:] != w.doc[:-1])
                at = np.flatnonzero(begin)
                size = np.diff(np.append(at, n))
                doc = w.doc[at]
                empty = np.flatnonzero(w.counts == 0)
                docs_ = np.concatenate([doc, empty])
                lang = np.concatenate([lab[at].astype(np.int64), np.full(len(empty), und)])
                start = np.concatenate([at - w.first[doc], np.zeros(len(empty), np.int64)])
                rank = np.arange(len(at)) - np.searchsorted(doc, doc)
                verdict = np.where(ok | (best >= len(model.languages)), best, und)
                verdict[w.counts == 0] = und
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i).take(pa.array(docs_)),
                        pa.array(np.concatenate([rank, np.zeros(len(empty), np.int64)]).astype(np.int32)),
                        pa.array(names[lang], pa.string()),
                        pa.array(start),
                        pa.array(np.concatenate([size, np.zeros(len(empty), np.int64)])),
                        pa.array(names[verdict[docs_]], pa.string()),
                        pa.array(ok[docs_]),
                    ],
                    schema=_SPANS,
                )

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t"))
    return d.mapInArrow(run, SPANS)


def accepted(model: LanguageModel, text: Column, penalty: float = SWITCH_PENALTY) -> Column:
    """Whether the language identification accepts a text; false for null."""

    @F.arrow_udf("boolean")
    def udf(t: pa.Array) -> pa.Array:
        out = []
        for i, j in tx.slices(t, _SLICE):
            buf, off = tx.raw(t.slice(i, j - i))
            out.append(_document_languages(model, *model.label(buf, off, penalty))[1])
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool), pa.bool_())

    return udf(F.lower(text))
