"""Secret scans by grammar inference.

From a labelled table of credentials and look-alikes, one probabilistic
automaton is inferred for each format: the prefix tree of its examples, whose
states are merged where their counts agree within Hoeffding bounds (ALERGIA,
Carrasco and Oncina 1994).  Every candidate, a run of key characters of any
length, is scored by all automata; it is a secret if a credential format is
likelier than every other by ``MARGIN`` nats.  The table is small and given:
(text, format, secret) rows, of which examples() reads ``EXAMPLE_ROWS`` at
most; the default one is drawn from the published shapes of the formats.

Defined results: null and empty texts have no candidates; texts and candidates
of any length are scored whole; equal likelihoods go to the format first in
the label table; repeated rows are scanned independently; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

MARGIN = 3.0
ALPHA = 0.05
EXAMPLES = 150
#: Most rows of a labelled table, which the driver infers automata from.
EXAMPLE_ROWS = 100_000

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/"
_SYM = np.full(256, -1, dtype=np.int16)
for _i, _c in enumerate(_CHARS.encode()):
    _SYM[_c] = _i
_K = len(_CHARS)
_KEY = _SYM >= 0

_WORDS = (
    "information government international because knowledge through understanding different without development between something "
    "entwicklung gesellschaft verantwortung unterschied zwischen freundschaft nachrichten wissenschaft schmetterling "
    "gouvernement connaissance maintenant aujourdhui developpement quelquechose toujours heureusement "
    "conocimiento desarrollo universidad importante naturaleza siempre trabajador responsabilidad "
    "the and with tion ing ment heit keit schaft ung eau eux que ciones mente ando ado esta para"
).split()


def labelled_examples(seed: int = 7, each: int = EXAMPLES) -> list[tuple[str, str, bool]]:
    """The small labelled table (text, format, whether a credential), drawn from the published shapes of the formats."""
    r = random.Random(seed)
    low, up, dig = _CHARS[:26], _CHARS[26:52], _CHARS[52:62]
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))

    def word(least: int) -> str:
        s = ""
        while len(s) < least:
            w = r.choice(_WORDS)
            i = r.randrange(max(1, len(w) - 3))
            s += w[i : i + r.randint(2, 7)]
        return s

    makers = {
        "plain_word": (False, lambda: word(r.randint(1, 30))),
        "title_word": (False, lambda: word(r.randint(1, 30)).capitalize()),
        "upper_word": (False, lambda: word(r.randint(1, 30)).upper()),
        "number": (False, lambda: pick(dig, r.randint(1, 22))),
        "short_code": (False, lambda: pick(low + up + dig, r.randint(1, 6))),
        "letters": (False, lambda: pick(low + up, r.randint(1, 12))),
        "hex_word": (False, lambda: pick("abcdef", r.randint(1, 12))),
        "mark": (False, lambda: r.choice("-_+/") * r.randint(1, 40)),
        "joined_words": (False, lambda: r.choice("-_/").join(word(3) for _ in range(r.randint(3, 6)))),
        "dated_name": (False, lambda: r.choice("-_/").join([word(4), pick(dig, 4), pick(dig, 2), pick(dig, 2)])),
        "camel_name": (False, lambda: "".join(word(4).capitalize() for _ in range(r.randint(3, 6))) + pick(dig, r.randint(0, 2))),
        "aws_access_key": (True, lambda: r.choice(["AKIA", "ASIA"]) + pick(up + dig, 16)),
        "hex_secret": (True, lambda: pick(dig + "abcdef", r.choice([16, 18, 20, 24, 32, 40, 64]))),
        "github_token": (True, lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(low + up + dig, 36)),
        "google_key": (True, lambda: "AIza" + pick(low + up + dig + "_-", 35)),
        "slack_token": (True, lambda: r.choice(["xoxb-", "xoxp-"]) + pick(dig, 12) + "-" + pick(dig, 12) + "-" + pick(low + up + dig, 24)),
        "stripe_key": (True, lambda: r.choice(["sk_live_", "rk_live_"]) + pick(low + up + dig, 24)),
        "web_token": (True, lambda: "eyJ" + pick(low + up + dig + "_-", r.randint(30, 90))),
        "mixed_secret": (True, lambda: pick(low + up + dig, r.choice([24, 32, 40]))),
        "base64_secret": (True, lambda: pick(low + up + dig + "+/", r.choice([32, 40, 44, 64]))),
    }
    return [(make(), name, secret) for name, (secret, make) in makers.items() for _ in range(each)]


def examples(table: DataFrame, text_col: str = "text", format_col: str = "format", secret_col: str = "secret") -> list[tuple[str, str, bool]]:
    """A labelled table's rows, ordered by format and text so that inference is the same each time; nulls are left out."""
    t = table.where(F.col(text_col).isNotNull() & F.col(format_col).isNotNull() & F.col(secret_col).isNotNull())
    rows = t.select(F.col(text_col).alias("t"), F.col(format_col).alias("f"), F.col(secret_col).cast("boolean").alias("s")).orderBy("f", "t").limit(EXAMPLE_ROWS).collect()
    return [(r["t"], r["f"], r["s"]) for r in rows]


class _Tree:
    """A prefix tree with counts, and the merges on it."""

    def __init__(self, strings: list[str]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.count, self.final, self.passed = [0], [0], [{}]
        for s in strings:
            q = 0
            self.count[0] += 1
            for c in s.encode():
                x = int(_SYM[c])
                if x not in self.next[q]:
                    self.next[q][x] = len(self.next)
                    self.next.append({})
                    self.count.append(0)
                    self.final.append(0)
                    self.passed.append({})
                self.passed[q][x] = self.passed[q].get(x, 0) + 1
                q = self.next[q][x]
                self.count[q] += 1
            self.final[q] += 1

    def differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.count[a], self.count[b]
            if self.differ(self.final[a], na, self.final[b], nb):
                return False
            for x in self.passed[a].keys() | self.passed[b].keys():
                if self.differ(self.passed[a].get(x, 0), na, self.passed[b].get(x, 0), nb):
                    return False
                if x in self.next[a] and x in self.next[b] and self.next[a][x] != self.next[b][x]:
                    stack.append((self.next[a][x], self.next[b][x]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the subtree of b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for x, n in self.passed[b].items():
                self.passed[a][x] = self.passed[a].get(x, 0) + n
                if x in self.next[a]:
                    stack.append((self.next[a][x], self.next[b][x]))
                else:
                    self.next[a][x] = self.next[b][x]


@dataclass
class Automaton:
    name: str
    secret: bool
    step: np.ndarray  # [state, symbol] the next state
    cost: np.ndarray  # [state, symbol or end] log-probabilities


def infer(strings: list[str], name: str, secret: bool) -> Automaton:
    """The automaton of a format: red states are kept, blue ones, their children, are merged into the latest compatible red state or become red."""
    t = _Tree(strings)
    red = [0]
    seen = {0}
    while True:
        blue = [(q, x, n) for q in red for x, n in sorted(t.next[q].items()) if n not in seen]
        if not blue:
            break
        q, x, b = max(blue, key=lambda e: (t.count[e[2]], -e[2]))
        for a in reversed(red):  # rare states are compatible with many; the latest one is nearest to them, the first would blur how a format begins
            if t.compatible(a, b):
                t.next[q][x] = a
                t.fold(a, b)
                break
        else:
            red.append(b)
            seen.add(b)
    number = {q: i for i, q in enumerate(red)}
    # after a symbol that no example has there, a look-alike goes on as it was; a credential is lost, in a last state of equal chances
    lost = len(red)
    step = np.repeat(np.full(lost + 1, lost, dtype=np.int32)[:, None] if secret else np.arange(lost + 1, dtype=np.int32)[:, None], _K, axis=1)
    cost = np.full((lost + 1, _K + 1), -math.log(_K + 1), dtype=np.float32)
    for q, i in number.items():
        total = t.count[q] + 0.02 * (_K + 1)
        cost[i] = math.log(0.02 / total)
        cost[i, _K] = math.log((t.final[q] + 0.02) / total)
        for x, n in t.passed[q].items():
            cost[i, x] = math.log((n + 0.02) / total)
            step[i, x] = number[t.next[q][x]]
    return Automaton(name, secret, step, cost)


def train(examples: list[tuple[str, str, bool]] | None = None) -> list[Automaton]:
    rows = labelled_examples() if examples is None else examples
    names = dict.fromkeys((name, secret) for _, name, secret in rows)
    return [infer([s for s, n, _ in rows if n == name], name, secret) for name, secret in names]


def likelihoods(automata: list[Automaton], buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[candidate, automaton] log-likelihoods, all candidates and automata a character at a time."""
    # all automata as one, a state of each side by side
    base = np.concatenate([[0], np.cumsum([len(m.step) for m in automata])])[:-1]
    step = np.concatenate([m.step + b for m, b in zip(automata, base, strict=True)]).ravel()
    cost = np.concatenate([m.cost for m in automata]).ravel()
    length = end - start
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    out = np.zeros((len(start), len(automata)))
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right") if len(n) else []
    state, total = np.tile(base, (len(s), 1)), np.zeros((len(s), len(automata)))
    for t, a in enumerate(live):
        x = _SYM[buf[s[:a] + t]].astype(np.int64)[:, None]
        total[:a] += cost[state[:a] * (_K + 1) + x]
        state[:a] = step[state[:a] * _K + x]
    out[order] = total + cost[state * (_K + 1) + _K]
    return out


def find(automata: list[Automaton], buf: np.ndarray, offsets: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, ...]:
    """(document, start, end, format, score) of the secrets in a slice, in order; candidates that are equal are scored once."""
    w = tx.words(buf, offsets, _KEY[buf])
    if not len(w.start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros(0)
    _, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    secret = np.array([m.secret for m in automata])
    best, score = np.zeros(len(one), dtype=np.int64), np.zeros(len(one))
    for i in range(0, len(one), 1 << 14):
        at = one[i : i + (1 << 14)]
        ll = likelihoods(automata, buf, w.start[at], w.end[at])
        best[i : i + len(at)] = k = np.where(secret, ll, -np.inf).argmax(axis=1)
        score[i : i + len(at)] = ll[np.arange(len(at)), k] - np.where(secret, -np.inf, ll).max(axis=1, initial=-np.inf)
    ok = np.flatnonzero(score[back] >= margin)
    return w.doc[ok], w.start[ok], w.end[ok], best[back[ok]], score[back[ok]]


RESULT = "doc_id long, start long, length long, format string, score double"


def scan(docs: DataFrame, automata: list[Automaton] | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row for each secret: its place in the text in characters, its likeliest format and by how many nats that is likelier than any look-alike."""
    models = train() if automata is None else automata
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("format", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([m.name for m in models], dtype=object)
        for b in batches:
            ids = tx.column(b, "doc_id")
            for i, j in tx.slices(tx.column(b, "t")):
                buf, off = tx.raw(tx.column(b, "t").slice(i, j - i))
                doc, start, end, best, score = find(models, buf, off, margin)
                at = np.array([int(np.count_nonzero((buf[off[d] : s] & 0xC0) != 0x80)) for d, s in zip(doc, start, strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(doc)), pa.array(at), pa.array(end - start), pa.array(names[best], pa.string()), pa.array(np.round(score, 4))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, RESULT)


def redacted(text: Column, automata: list[Automaton] | None = None, mark: str = "[SECRET]", margin: float = MARGIN) -> Column:
    """The text with each secret replaced by ``mark``; null stays null."""
    models = train() if automata is None else automata

    @F.arrow_udf("string")
    def udf(t: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for i, j in tx.slices(t):
            part = t.slice(i, j - i).cast(pa.string())
            buf, off = tx.raw(part)
            doc, start, end, _, _ = find(models, buf, off, margin)
            if len(doc):
                rows = part.to_pylist()
                for d in np.unique(doc):
                    pieces, last = [], off[d]
                    for s, e in zip(start[doc == d], end[doc == d], strict=True):
                        pieces += [buf[last:s].tobytes().decode(), mark]
                        last = e
                    rows[d] = "".join([*pieces, buf[last : off[d + 1]].tobytes().decode()])
                part = pa.array(rows, pa.string())
            out.append(part)
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return udf(text)
