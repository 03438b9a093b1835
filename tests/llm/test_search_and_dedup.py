"""N-gram join, repeated passages, top-k search and embedding near-duplicates against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rastrum.llm import neardup, ngram_join, suffix, topk

from .helpers import SCHEMA, corpus, documents, grams, words


def brute_links(rows, n, t):
    """Each row's (id, class, links), of rows with a link."""
    sets = [(i, grams(x, n)) for i, x, *_ in rows if i is not None]
    sets = [(i, x) for i, x in sets if x]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for m in range(k + 1, len(sets)):
            b = sets[m][1]
            if len(a & b) / len(a | b) >= t:
                links[k] += 1
                links[m] += 1
                root[find(k)] = find(m)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets) if links[k])


def linked(docs, *args, **options):
    return sorted(tuple(r) for r in ngram_join.similar_documents(docs, *args, **options).collect())


@pytest.mark.parametrize(("seed", "n", "t", "block", "slack"), [(0, 3, 0.5, 1 << 21, 0.1), (1, 2, 0.6, 150, 0.2), (2, 1, 0.3, 400, 0.05), (5, 1, 0.07, 300, 0.1), (6, 2, 0.9, 1 << 21, 0.3)])
def test_join_equals_brute_force(spark, seed, n, t, block, slack):
    rows = corpus(seed)
    got = linked(documents(spark, rows), n, t, block=block, slack=slack, frequent=20)
    assert got == brute_links(rows, n, t) and got


@pytest.mark.parametrize("t", [0.07, 0.55, 0.6, 0.7])
def test_similarities_of_just_the_threshold(spark, t):
    """Of 100 words a subset of exactly t: floating-point products must not lose the pair."""
    words_ = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words_), "en", "s"), (2, " ".join(words_[: round(100 * t)]), "en", "s"), (3, " ".join(words_[: round(100 * t) - 1]), "en", "s")]
    got = linked(documents(spark, rows), 1, t)
    assert got == brute_links(rows, 1, t) and (1, 1, 1) in got


def test_join_within_one_large_group(spark):
    """Many near copies of one text, at all distances around the threshold, in many families and blocks."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(r.choice(["x", "y", "z"]) if r.random() < 0.005 * (i % 60) else w for w in base), "en", "s") for i in range(150)]
    for block in (2000, 1 << 21):
        got = linked(documents(spark, rows), 1, 0.75, block=block, slack=0.12)
        assert got == brute_links(rows, 1, 0.75) and len({n for *_, n in got}) > 5


def test_shared_counts_do_not_grow_with_buckets(spark):
    """Sets whose grams occur elsewhere by chance: counts against loops; what is shuffled hardly depends on the number of buckets."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]  # few grams occur more than twice, so that the list of frequent ones stays short
    rows = [(i, " ".join(r.choice(vocab) for _ in range(400)), "en", "s") for i in range(150)]
    docs = ngram_join._texts(documents(spark, rows).repartition(2), "doc_id", "text")
    keys = {x["doc_id"]: x["key"] for x in ngram_join.set_rows(docs, 3).collect()}

    def sent():
        sc = spark._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    texts = ngram_join.written(docs, "texts")
    got, most, old = [], [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            before = sent()
            got.append({x["key"]: x["shared"] for x in ngram_join._shared_grams(texts, 3, 20)[0].collect()})
            most.append(sent() - before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    sets = {i: grams(t) for i, t, *_ in rows}
    df = Counter(x for s in sets.values() for x in s)
    assert got[0] == got[1] == {keys[i]: sum(df[x] > 1 for x in s) for i, s in sets.items()}
    assert most[1] < 2 * most[0], most


def test_sets_that_share_too_little_are_no_candidates(spark):
    """A set that shares under 2/3 of its grams has no partner of its size, however many grams it has in common with others."""
    words_ = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words_[:33] + [f"own{i}x{k}" for k in range(27)]), "en", "s") for i in range(30)]
    rows += [(100, " ".join(words_), "en", "s"), (101, " ".join(words_[:40]), "en", "s"), (102, " ".join(words_[:36]), "en", "s")]
    assert linked(documents(spark, rows), 1) == brute_links(rows, 1, 0.5)
    texts = ngram_join._texts(documents(spark, rows), "doc_id", "text")
    cand = ngram_join._shared_grams(texts, 1, 20)[0].join(ngram_join.set_rows(texts, 1), "key")
    hot = spark.createDataFrame([], "least long, salts long")
    fam = ngram_join.families(texts, cand, hot, 1, 0.1)
    pairs = ngram_join.candidate_pairs(fam.where("key = leader"), 0.5, 0.1, np.zeros(0, np.uint64)).collect()
    own = {x["key"] for x in cand.collect() if x["doc_id"] < 100}
    assert len(own) == 30 and not [x for x in pairs if x["a"] in own and x["b"] in own]


def test_pairs_of_near_copies_are_counted_before_they_are_sent(spark):
    """Near copies of one text meet in all buckets: no row a pair and bucket is shuffled, each pair comes once and no link is missing."""
    r = random.Random(12)
    rows = [(i, " ".join(f"own{i}x{k}" if r.random() < 0.002 * i else f"w{k}" for k in range(160)), "en", "s") for i in range(200)]
    sc, old = spark._jsc.sc(), spark.conf.get("spark.sql.shuffle.partitions")

    def sent():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        texts = ngram_join.written(ngram_join._texts(documents(spark, rows), "doc_id", "text"), "texts")
        cand = ngram_join._shared_grams(texts, 1, 20)[0].join(ngram_join.set_rows(texts, 1), "key")
        fam = ngram_join.written(ngram_join.families(texts, cand, spark.createDataFrame([], "least long, salts long"), 1, 0.0), "families")
        before = sent()
        pairs = [(x["a"], x["b"]) for x in ngram_join.candidate_pairs(fam.where("key = leader"), 0.5, 0.0, np.zeros(0, np.uint64)).collect()]
        most = sent() - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    sets = {i: grams(t, 1) for i, t, *_ in rows}
    ids = {x["key"]: x["doc_id"] for x in cand.collect()}
    got = {frozenset((ids[a], ids[b])) for a, b in pairs}
    assert len(got) == len(pairs)
    assert not {frozenset((i, j)) for i in ids.values() for j in ids.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5 and sets[i] != sets[j]} - got
    assert len(pairs) > 10_000 and most < 100 * len(pairs), (most, len(pairs))


def test_join_of_repeated_and_null_ids(spark):
    rows = corpus(3, n=6, copies=6)
    rows += [(1, rows[2][1], "en", "s"), (1, rows[1][1], "en", "s"), (None, rows[1][1], "en", "s"), (500, "x " * 3000, "en", "s"), (501, "x " * 2999, "en", "s")]
    got = linked(documents(spark, rows))
    assert got == brute_links(rows, 3, 0.5) and (501, 500, 1) in got
    assert ngram_join.similar_documents(documents(spark, rows).where("false")).count() == 0


def test_incremental_overlaps():
    r = np.random.default_rng(0)
    base = r.choice(1000, 60, replace=False)
    sets = [np.unique(np.concatenate([base[r.random(60) < 0.9], r.choice(5000, 5)])).astype(np.uint64) for _ in range(30)]
    for queries in (sets, [s[::2] for s in sets[:7]]):
        got = {i: c.tolist() for i, c in ngram_join.overlaps(queries, sets)}
        assert got == {i: [len(np.intersect1d(q, s)) for s in sets] for i, q in enumerate(queries)}


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    drop = {i for i, c, _ in brute_links(rows, 3, 0.5) if i != c}
    out = ngram_join.deduplicated(documents(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, *_ in rows if i not in drop) and drop
    assert out.columns == documents(spark, rows).columns


def brute_repeats(rows, length, inside):
    where = defaultdict(list)
    for i, t, *_ in rows:
        w = words(t) if i is not None else []
        for p in range(len(w) - length + 1):
            where[tuple(w[p : p + length])].append((i, p))
    out = set()
    for v in where.values():
        docs = sorted({i for i, _ in v})
        if len(docs) > 1:
            out |= {(i, p, docs[1] if i == docs[0] else docs[0]) for i, p in v}
        elif inside and len(v) > 1:
            out |= {(i, p, i) for i, p in v}
    return out


@pytest.mark.parametrize(("seed", "length", "inside"), [(0, 50, False), (1, 12, True), (2, 7, False), (0, 50, True), (3, 1, False)])
def test_repeats_equal_brute_force(spark, seed, length, inside):
    rows = corpus(seed, n=25, length=(5, 150))
    passage = " ".join(rows[0][1].split()[:60]) if len(rows[0][1].split()) >= 60 else "p q r s t u v w x y z " * 6
    rows = [*rows, *((200 + k, f"{'z' * k} {passage} tail{k}", "en", "s") for k in range(5)), (300, f"{passage} and {passage}", "en", "s"), (None, passage, "en", "s"), (300, passage, "en", "s"), (301, "same line " * 400, "en", "s")]
    found = suffix.repeats(documents(spark, rows), length, inside=inside).collect()
    got = {(r["doc_id"], p, r["other_doc"]) for r in found for p in range(r["start_word"], r["start_word"] + r["n_words"] - length + 1)}
    assert got == brute_repeats(rows, length, inside) and got
    assert inside or all(r["doc_id"] != 301 for r in found)  # it repeats only inside itself


def test_offsets_grow_to_the_length():
    assert suffix.offsets(50, 16) == [16, 18] and suffix.offsets(7, 2) == [2, 3] and suffix.offsets(200, 16) == [16, 32, 64, 72] and suffix.offsets(3, 3) == []


def test_repeats_of_nothing(spark):
    assert suffix.repeats(documents(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, "short", "en", "s"), (4, "short", "en", "s")])).count() == 0
    assert suffix.repeats(documents(spark, []).where("false")).count() == 0


def test_anchors_are_shared():
    """Equal windows have equal anchors, wherever they lie."""
    r = np.random.default_rng(1)
    common = r.integers(1, 1 << 60, 50, dtype=np.uint64)
    for before in (0, 3, 40):
        h = np.concatenate([r.integers(1, 1 << 60, before, dtype=np.uint64), common, r.integers(1, 1 << 60, 20, dtype=np.uint64)])
        at, _ = suffix.anchors(h, np.zeros(len(h), int), 50, 16)
        own, _ = suffix.anchors(common, np.zeros(50, int), 50, 16)
        assert set(own + before) <= set(at)


def brute_top(docs, queries, k):
    sets = defaultdict(set)
    for i, t, *_ in docs:
        if i is not None:
            sets[i] |= grams(t)
    asked = defaultdict(set)
    for q, t in queries:
        if q is not None:
            asked[q] |= grams(t)
    n = len({i for i, t, *_ in docs if i is not None and t is not None})
    df = Counter(g for s in sets.values() for g in s)
    out = set()
    for q, gs in asked.items():
        score = {i: sum(max(1, round(1000 * math.log(n / df[g]))) for g in gs & s) for i, s in sets.items() if gs & s}
        best = sorted(score, key=lambda i: (-score[i], i))[:k]
        out |= {(q, p + 1, i, score[i]) for p, i in enumerate(best)}
    return out


@pytest.mark.parametrize(("seed", "lists", "k"), [(0, 4, 10), (1, 1, 3), (2, 7, 1)])
def test_topk_equals_brute_force(spark, seed, lists, k):
    docs = corpus(seed, vocabulary=12, length=(5, 40))
    docs += [docs[3], (None, docs[3][1], "en", "s")]
    queries = [(i, t) for i, t, *_ in docs[5:25]] + [(900, None), (901, ""), (902, "zz qq"), (None, "x"), (903, "one"), (6, docs[9][1])]
    got = topk.search(documents(spark, docs), spark.createDataFrame(queries, "item_id long, text string"), k, lists=lists)
    assert {tuple(r) for r in got.collect()} == brute_top(docs, queries, k)


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, corpus(0, n=3, copies=0))
    assert topk.search(docs, empty).count() == 0
    assert topk.search(docs.where("false"), spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0


def brute_vectors(rows, t):
    """Each usable row's (id, class, links)."""
    ids = np.array([i for i, *_ in rows])
    u = np.asarray([v for _, v, *_ in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= t
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return sorted((int(i), int(ids[label == c].min()), int(n)) for i, c, n in zip(ids, label, near.sum(axis=1), strict=True))


@pytest.mark.parametrize("block", [4096, 20])
def test_embeddings_recall_and_oddities(spark, block):
    """Classes and links as by brute force, also where buckets are split into blocks."""
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32))
    v = np.concatenate([centres[r.integers(0, 40, 400)] + r.standard_normal((400, 32)) * s for s in (0.05, 0.8)])
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(len(v))]
    odd = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [float("inf")] + [0.0] * 31, 1), (9004, [1.0], 1), (9005, [None] + [1.0] * 31, 1), (None, rows[0][1], 1)]
    copies = [rows[5], (9006, rows[5][1], 1)]
    table = spark.createDataFrame([(*x, 7, 8.0) for x in rows + odd + copies], "vec_id long, embedding array<float>, label int, key int, v double")
    for t, least in ((0.95, 1.0), (0.7, 0.97)):
        got = sorted(tuple(x) for x in neardup.near_duplicates(table, t, block=block, miss=1e-4).collect())
        want = brute_vectors(rows + copies, t)
        assert [x[0] for x in got] == [x[0] for x in want]
        assert sum(x[2] for x in want) >= sum(x[2] for x in got) >= least * sum(x[2] for x in want) > 0
        if least == 1:
            assert got == want
    assert neardup.near_duplicates(table.where("false")).count() == 0


def test_index_recall(spark):
    """Of pairs of just over the threshold, with the production parameters, at least nine in ten are found."""
    r = np.random.default_rng(3)
    a = r.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.standard_normal((300, 64))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.955 * a + (1 - 0.955**2) ** 0.5 * side
    fill = r.standard_normal((6000, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b, fill]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("n_links = 1 AND vec_id >= 300 AND class_id = vec_id - 300").count()
    assert got >= 285 and len(neardup.table_masks(6600, 64, 0.95)) > 5


def test_extra_columns_stay_out(spark):
    assert ngram_join.similar_documents(documents(spark, corpus(0, n=4))).columns == [c.split()[0] for c in ngram_join.RESULT.split(", ")]
    assert "grams" in SCHEMA and random


def test_join_where_most_texts_are_empty(spark):
    rows = [(i, "" if i % 5 else None, "en", "s") for i in range(40)] + [(100, "only one text here", "en", "s")]
    assert ngram_join.similar_documents(documents(spark, rows).repartition(8)).count() == 0
    assert ngram_join.similar_documents(documents(spark, rows[:40])).count() == 0
    assert ngram_join.deduplicated(documents(spark, rows)).count() == 41
