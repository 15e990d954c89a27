"""Periodic runs, toxicity and vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens.llm import periodic_runs, queries, toxicity, vector_codes

from .conftest import TEXTS

TEXT = "doc_id bigint, text string"


def _runs(words, least=12):
    """Every run as (start, length, period), by walking along each period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def _periodic(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    kind = rng.randrange(4)
    if kind == 1 and n > 4:
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
        words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
    if kind == 2:
        words = words[:max(1, n // 6)] * 6
        words[rng.randrange(len(words))] = "odd"
    return words


@pytest.mark.parametrize("least", [12, 5, 2])
def test_runs_of_random_texts(least):
    rng = random.Random(least)
    for _ in range(60):
        docs = [_periodic(rng, rng.randrange(1, 120), "abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(1, 5))]
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = sorted(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, doc, least))))
        first = np.cumsum([0] + [len(d) for d in docs])
        want = [(s + o, s + o + n, p) for d, o in zip(docs, first.tolist()) for s, n, p in _runs(d, least)]
        assert got == sorted(want)


def test_runs_of_words_with_structure():
    """Fibonacci and Thue-Morse words, one word and one period, over several thousand words."""
    fib, morse = [[0], [0, 1]], [0]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 2048:
        morse += [1 - x for x in morse]
    for words in (fib[-1][:1500], morse, [7] * 900, [i % 7 for i in range(1200)]):
        got = periodic_runs.find_runs(np.array(words), np.zeros(len(words), int))
        assert sorted((s, e - s, p) for s, e, p in zip(*(x.tolist() for x in got))) == _runs(words)


def test_hashes_alone_make_no_run(monkeypatch):
    """Hashes that call everything equal are found out, the next bases decide."""
    equal, tries = periodic_runs._Hashes.equal, []

    class Blind(periodic_runs._Hashes):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            self.seed = seed
            tries.append(seed)

        def equal(self, i, n, period):
            return np.ones(len(i), bool) if self.seed == 0 else equal(self, i, n, period)

    monkeypatch.setattr(periodic_runs, "_Hashes", Blind)
    words = [1, 2, 3] * 5 + [4, 5, 6, 7] + [1, 2, 3] * 6
    got = periodic_runs.find_runs(np.array(words), np.zeros(len(words), int))
    assert sorted((s, e - s, p) for s, e, p in zip(*(x.tolist() for x in got))) == _runs(words) and len(tries) > 1


def test_grammar_derives_the_text():
    rng = random.Random(4)
    ids = np.array([rng.randrange(3) for _ in range(700)])
    doc = np.repeat([0, 1, 2], [300, 1, 399])
    g = periodic_runs.Grammar(ids, doc)
    assert g.rules > 10
    for k in range(g.rules):
        text = ids[g.lo[k]:g.hi[k]].tolist()
        places = g.lo[k] + g.shift[g.node == k]
        assert len(places) > 1 and g.lo[k] < g.at[k] < g.hi[k]
        for p in places:
            assert ids[p:p + len(text)].tolist() == text and doc[p] == doc[p + len(text) - 1]
    # Each stretch of two words or more lies in a node and crosses its boundary.
    spans = [(g.lo[k] + s, g.at[k] + s, g.hi[k] + s) for k, s in zip(g.node, g.shift)]
    for _ in range(200):
        a = rng.randrange(300)
        b = rng.randrange(a + 1, 301)
        assert b - a < 2 or any(lo <= a < at < b <= hi for lo, at, hi in spans)


def test_word_runs(spark, odd_docs, no_docs):
    rng = random.Random(1)
    texts = [(i, " ".join(_periodic(rng, rng.randrange(1, 200), ["é", "b", "c d", "E"][:1 + i % 4])))
             for i in range(80)] + [(1000, "x y\tz\n" * 30000), (1000, "other")]
    docs = odd_docs.unionByName(spark.createDataFrame(texts, TEXT), allowMissingColumns=True)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic_runs.word_runs(docs).collect())
    want = []
    for i, t in [(i, t) for i, t, _ in TEXTS] + texts:
        words = (t or "").encode().split()
        runs = [(0, 90000, 3)] if len(words) == 90000 else _runs(words)
        want.append((str(i), len(words), runs, _collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic_runs.word_runs(no_docs).count() == 0


def test_op11_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(151, None)]
    spark.createDataFrame(rows, TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, t in rows:
        words, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = _runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == digest("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == digest(_collapsed(words, runs))
    assert planted > 5 and len(got) == len(rows)


# ---- toxicity -------------------------------------------------------------------------------------------------

def _toxic_rows(n, rng):
    insults = [["foulwort", "grimble", "snarkle"], ["pesti" + x for x in ("a", "en", "o", "ul", "ex")]]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(insults[i % 4 // 2], 2):
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    return rows, labels


def test_toxicity(spark, odd_docs, no_docs):
    rows, given = _toxic_rows(900, random.Random(5))
    docs = spark.createDataFrame(rows, TEXT)
    labels = spark.createDataFrame(given + [(0, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs.withColumns({"score": F.lit("x"), "label": F.lit(1), "_id": F.lit(2)}), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98 and len(held) > 100
    odd = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len(odd) == len(TEXTS) and all(r.score == 0.5 and r.predicted == 1 for r in odd)
    taught = toxicity.toxicity(odd_docs, spark.createDataFrame([(0, 1), (5, 0), (8, 0), (None, 1)], "doc_id bigint, toxic int"))
    assert taught.count() == len(TEXTS)
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_toxicity_scores_are_those_of_the_model(spark):
    """Voters counted and weighed by plain code; wrong labels are outvoted, held-out labels change nothing."""
    rows, given = _toxic_rows(600, random.Random(8))
    docs, labels = spark.createDataFrame(rows, TEXT), spark.createDataFrame(given, "doc_id bigint, toxic int")
    model = toxicity.fit_model(docs, labels)
    assert {"foul*", "pes*"} & {n[:4] + "*" for n in model.voters.names} | {n for n in model.voters.names if n == "pes*"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        words, z = text.lower().split(), model.weights[-1]
        for name, w in zip(model.voters.names, model.weights):
            if name in toxicity.PATTERNS:
                n = toxicity.PATTERNS[name](text, words)
            else:
                n = sum(x.startswith(name[:-1]) if name.endswith("*") else x == name for x in words)
            z += w * math.log1p(n)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in given]
    again = toxicity.fit_model(docs, spark.createDataFrame(flipped, "doc_id bigint, toxic int"))
    assert again.voters.names == model.voters.names and np.array_equal(again.weights, model.weights)


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known chances; two voters copy another."""
    rng = np.random.default_rng(3)
    n = 20_000
    y = rng.random(n) < 0.2
    chance = np.array([[0.02, 0.6], [0.1, 0.5], [0.05, 0.4], [0.3, 0.3]])
    votes = (rng.random((n, 4)) < chance[:, y.astype(int)].T).astype(int)
    copies = np.where(rng.random((n, 2)) < 0.95, votes[:, :1], rng.integers(0, 2, (n, 2)))
    votes = np.column_stack([votes, copies])
    votes = np.column_stack([votes, 1 - votes.max(axis=1)])
    given = np.where(rng.random(n) < 0.3, y, -1)
    given = np.where((given >= 0) & (rng.random(n) < 0.02), 1 - given, given)
    model = toxicity.fit_labels(votes, given)
    links = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert frozenset((0, 4)) in links and frozenset((0, 5)) in links
    assert abs(model.prior - 0.2) < 0.1
    free = given < 0
    rank = np.argsort(np.argsort(model.posterior[free]))
    n1 = int(y[free].sum())
    auc = (rank[y[free]].sum() - n1 * (n1 - 1) / 2) / (n1 * (free.sum() - n1))
    assert auc > 0.85 and ((model.posterior > 0.5) == y)[~free].mean() > 0.9


# ---- vector codes -------------------------------------------------------------------------------------------

def _codes(rows, entries=64, rounds=2):
    """(id, label, vector) rows coded with Python's whole numbers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    part = len(kept[0][2]) // 16
    books = [[r[2][k * part:(k + 1) * part] for r in kept[:entries]] for k in range(16)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(16):
            own = {}
            for _, _, v in kept:
                x = v[k * part:(k + 1) * part]
                own.setdefault(near(books[k], x)[1], []).append(x)
            for j, xs in own.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out, total = [], {}
    for i, lab, v in kept:
        found = [near(books[k], v[k * part:(k + 1) * part]) for k in range(16)]
        out.append((i, lab, bytes(j for _, j in found).hex(), sum(d for d, _ in found)))
        total[lab] = total.get(lab, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, total[lab], digest) for i, lab, c, e in out)


VECTOR = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("width, spread", [(16, 1), (32, 3), (64, 30000)])
def test_vector_codes(spark, monkeypatch, width, spread):
    monkeypatch.setattr(vector_codes, "BLOCK", 70)
    rng = np.random.default_rng(width)
    base = rng.normal(size=(12, width)) * spread
    rows = [(int(i), int(i) % 5 if i % 7 else None, [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=width) * 0.05])
            for i in rng.permutation(260)]
    rows += [(300, 1, rows[0][2]), (300, 2, rows[1][2]), (3, 1, rows[2][2]), (None, None, rows[3][2]), (301, 1, None),
             (302, 1, [float("nan")] * width), (303, 1, [None] + [0.5] * (width - 1)), (304, 1, [float("inf")] * width),
             (305, None, [0.0] * width), (306, 1, rows[5][2])]
    vectors = spark.createDataFrame(rows, VECTOR).withColumns({c: F.lit("x") for c in ("id", "code", "p", "l", "vec", "n")})
    got = vector_codes.vector_codes(vectors.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == _codes(rows)


def test_vector_codes_of_few_and_odd_rows(spark):
    few = [(2, 1, [0.1 * k for k in range(16)]), (1, 1, [0.1 * k for k in range(16)]), (1, None, [-0.1 * k for k in range(16)])]
    assert sorted((str(r.vec_id), *r[1:]) for r in vector_codes.vector_codes(spark.createDataFrame(few, VECTOR)).collect()) == [
        (i, c, e, t, d) for i, c, e, t, d in _codes([(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in few])]
    none = spark.createDataFrame(few, VECTOR).limit(0)
    assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    # Lengths that differ from the first coded one or can't be cut, and sizes that leave a long, are not coded.
    odd = few + [(0, 1, [1.0] * 7), (0, 1, []), (5, 1, [1.0] * 32), (6, 1, [3e38] * 16)]
    got = vector_codes.vector_codes(spark.createDataFrame(odd, VECTOR)).collect()
    assert sorted(r.vec_id for r in got) == [1, 1, 2]


def test_trees_hold_their_points_and_own_balls():
    rng = np.random.default_rng(2)
    for n, width, high in ((1, 2, 5), (400, 1, 4), (900, 3, 900), (700, 4, 2 ** 27)):
        points = rng.integers(-high, high, (n, width))
        tree = vector_codes.Tree.unpack(vector_codes.Tree(points).pack())
        assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
        for b, (i, j) in enumerate(zip(tree.start, tree.end)):
            assert (tree.sums[b] == tree.points[i:j].sum(0)).all()
            assert (np.sqrt(((tree.points[i:j] - tree.centre[b]) ** 2).sum(1)) <= tree.radius[b] * (1 + 1e-9) + 1e-9).all()
            if tree.left[b] >= 0:
                assert tree.start[tree.left[b]] == i and tree.end[tree.left[b]] == tree.start[tree.right[b]]
                assert tree.end[tree.right[b]] == j
        book = points[rng.integers(0, n, 30)]
        far = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        sums, counts, codes = vector_codes.assign(tree, book, True)
        assert (codes == far[tree.order]).all() and (counts == np.bincount(far, minlength=30)).all()
        assert all((sums[e] == points[far == e].sum(0)).all() for e in range(30))
