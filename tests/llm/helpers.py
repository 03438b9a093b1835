"""Small corpora with everything that can go wrong in them."""

from __future__ import annotations

import random
import re

WORD = re.compile("[0-9A-Za-z_ªµºÀ-῿⁀-⿿぀-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, bucket int, node long, comp long, h string, grams string, shard int, toxic int, score double, a long, sketch string, word long"


def words(text):
    return WORD.findall((text or "").lower())


def grams(text, n=3):
    w = words(text)
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2, 3, "h", "g", 4, 1, 0.5, 5, "s", 6) for r in rows], SCHEMA)


def corpus(seed=0, n=40, vocabulary=400, copies=20, length=(20, 120)):
    """(id, text, lang, source) with near copies, exact copies and odd rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(*length))) for _ in range(n)]
    for _ in range(copies):
        w = r.choice(texts[:n]).split()
        for _ in range(r.randint(0, max(1, len(w) // 8))):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [None, "", "   \n", "?!", "one", "two words", "two words", texts[0], "Ünïcode — “quoted” ñandú " * 3]
    return [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
