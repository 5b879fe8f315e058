"""Spelling variants, lexical search and exact top-k against plain Python versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.llm.lexical import Search, Stratum, ranked
from landgrid.llm.spelling import near_words, spelling_variants, vocabulary
from landgrid.llm.threshold import Lists, exact_top_k


def _counts(rows, dropped=97):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if _near(w, x))
        best = near[0] if near and -near[0][0] >= 2 * n else None
        out[w] = [best and best[1], n, len(near), best and -best[0]]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.insert(1, root)
    return {(w, *row) for w, row in out.items()}


def _texts(seed=3, rows=300):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé×ÿÀxyz") for _ in range(rnd.randint(4, 9))) for _ in range(60)]

    def spoilt(word):
        kind, at = rnd.randint(0, 5), rnd.randrange(len(word))
        return {0: word[:at] + word[at + 1 :], 1: word[:at] + rnd.choice("abxé") + word[at:], 2: word[:at] + rnd.choice("abxé") + word[at + 1 :]}.get(kind, word)

    out = [(k, " ".join(spoilt(rnd.choice(base)).title() if rnd.random() < 0.2 else spoilt(rnd.choice(base)) for _ in range(60))) for k in range(rows)]
    return [*out, (7, out[7][1]), (None, out[8][1]), (900, None), (901, ""), (902, "1 2 — 3"), (903, "a" * 70 + " " + "ab" * 80)]


def test_vocabulary_counts_words_of_whole_texts(spark):
    rnd = random.Random(5)
    long = (5000, " ".join(rnd.choice(["maison", "Élève", "número", "x" * 90, "tail—wörd"]) for _ in range(400_000)))
    rows = [*_texts(), long]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, word string")
    assert {r["word"]: r["n"] for r in vocabulary(docs).collect()} == _counts(rows)
    plain = vocabulary(docs, dropped=None)
    assert {r["word"]: r["n"] for r in plain.collect()} == _counts(rows, None)
    assert vocabulary(docs.limit(0)).count() == 0


@pytest.mark.parametrize("symbols", [2, 8])
def test_spelling_variants_equal_brute_force(spark, symbols):
    counts = _counts(_texts(), 5)
    rnd = random.Random(1)
    for size in (39, 40, 41, 42, 90):  # around the border beyond which words meet by halves
        word = "".join(rnd.choice("ab") for _ in range(size))
        for k, x in enumerate((word, word[1:], word[:-1], word[: size // 2] + "c" + word[size // 2 + 1 :], word[: size // 2] + "c" + word[size // 2 :])):
            counts[x] = 3 + k * size
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(words, symbols=symbols).collect()}
    assert found == _variants(counts)
    assert any(row[1] and row[2] != row[1] for row in found), "some chain has two steps"


def test_variants_of_odd_words(spark):
    words = spark.createDataFrame([("", 9), ("a", 4), ("b", 4), (None, 5)], "word string, n bigint")
    assert {(r["a"], r["b"]) for r in near_words(words).collect()} == {("", "a"), ("", "b"), ("a", "b")}
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling_variants(words).collect()}
    assert got == {"": (None, "", 2), "a": ("", "", 2), "b": ("", "", 2), None: (None, None, 0)}
    assert spelling_variants(words.limit(0)).count() == 0


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def _ranked(docs, items, k=10):
    texts = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    total, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in _terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(name, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _library(rows=400, seed=9):
    rnd = random.Random(seed)
    pool = [f"w{k}" for k in range(120)]
    texts = [" ".join(rnd.choices(pool, weights=range(1, 121), k=rnd.choice([3, 10, 10, 10, 40, 200]))) for _ in range(rows)]
    docs = [(k, t) for k, t in enumerate(texts)]
    docs += [(rows + k, texts[5]) for k in range(30)] + [(3, texts[3]), (None, texts[4]), (901, None), (902, ""), (903, "?!"), (904, "W1 w2 É " * 200_000)]
    items = [(k, " ".join(rnd.choices(pool, k=rnd.randint(1, 30)))) for k in range(12)] + [(20, texts[5]), (21, None), (22, "absent"), (23, "É w1 w1"), (None, "w3")]
    return docs, items


def test_ranked_equals_scoring_everything(spark):
    docs, items = _library()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    want = _ranked(docs, items)
    for options in ({}, {"postings": 50}, {"item_terms": 20}):
        got = sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked(d, i, **options).collect()], key=str)
        assert got == want
    assert ranked(d.limit(0), i).count() == 0 and ranked(d, i.limit(0)).count() == 0
    names = spark.createDataFrame([(f"d{k}", t) for k, t in docs[:50]], "doc_id string, text string")
    assert len(ranked(names, i, k=3).collect()) == len(_ranked(docs[:50], items, 3))


def test_items_skip_strata_that_cannot_reach_their_best():
    import pyarrow as pa

    def stratum(m, tf, first):
        return Stratum(m, np.zeros(20, np.int64), np.full(20, tf), np.ones(20, np.int64), pa.array(range(first, first + 20)))

    search = Search(np.array([0, 1]), np.array([0]), np.array([7]), 10)
    search.visit([stratum(500, 1, 0), stratum(30, 9, 100), stratum(400, 2, 200)])
    assert search.visits == 1 and [i for _, _, i in search.best[0]] == list(range(100, 110))


def _top(rows, k=5):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(sound):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for j, (i, c) in enumerate(sound) if j != at and len(c) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_exact_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    rows = [(k, rnd.normal(0, 0.2, 8).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[50][1]) for k in range(20)] + [(50, rows[50][1]), (None, rows[1][1])]  # ties, repeated rows
    rows += [(2000, None), (2050, [None] * 8), (2100, [math.nan] * 8), (2150, [math.inf] * 8), (2200, [0.0] * 8), (2250, []), (2251, [])]
    rows += [(3000, [0.5, -0.5]), (3001, [0.1, 0.2]), (3002, [-1.0, 3.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, row int")
    want = _top(rows)
    for options in ({}, {"shard_numbers": 700, "block_queries": 3}):
        found = exact_top_k(table, F.col("vec_id") % 50 == 0, **options).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == want
    assert exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_huge_components_are_scored_exactly_and_cut(spark):
    rows = [(0, [1e13, 1.0]), (1, [2e13, -1.0]), (2, [-1e300, 0.0]), (3, [1e3, 5.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = exact_top_k(table, F.col("vec_id") == 0).orderBy("rank").collect()
    exact = 256 * 10**13 * 256 * 1000 + 256 * 256 * 5
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 2**63 - 1), (3, min(exact, 2**63 - 1)), (2, -(2**63))]


def test_threshold_stops_reading_lists_early():
    rnd = np.random.default_rng(4)
    vectors = np.floor(rnd.normal(0, 3, (5000, 4))).astype(np.int64)
    vectors[:6] = 400
    lists = Lists(vectors, np.arange(5000), np.arange(5000))
    found, read = lists.best(np.array([5, 3, 2, 9]), 0, 5)
    assert [i for i, _ in found] == [1, 2, 3, 4, 5] and read < 200
