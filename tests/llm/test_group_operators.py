"""Operators on groups, vectors, sources and labels against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from blocklens.llm import mixing, near_dedup as near, quality
from blocklens.llm.embedding_dedup import embedding_dedup
from blocklens.llm.near_dedup import near_dedup
from blocklens.llm.substring_dedup import substring_dedup
from blocklens.llm.suffix_array import suffix_ranks

from .conftest import TEXTS

TEXT = "doc_id bigint, text string"


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        out[at:at + (kind < 0.7)] = [] if kind < 0.2 else [f"n{rng.randrange(10 ** 6)}"]
    return " ".join(out)


@pytest.mark.parametrize("words, percent, frequent", [(3, 85, 1 << 18), (5, 80, 3), (3, 85, 0)])
def test_near_dedup(spark, odd_docs, no_docs, words, percent, frequent):
    rng = random.Random(words)
    base = [[f"w{rng.randrange(60)}" for _ in range(120)] for _ in range(2)]
    texts = [(1000 + i, _edited(rng, base[i % 2], rng.randint(0, 8))) for i in range(60)]
    texts += [(i, t) for i, t, _ in TEXTS] + [(2000, texts[3][1]), (2001, texts[3][1].upper())]
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.setdefault(i, []).append({tuple(w[k:k + words]) for k in range(max(len(w) - words + 1, min(len(w), 1)))})
    nodes = [i for i in sets if i is not None]
    links = [(a, b) for a in nodes for b in nodes if a < b for x in sets[a] for y in sets[b]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = _roots(nodes, links)
    docs = odd_docs.select("doc_id", "text", "kept", "n", "id").unionByName(
        spark.createDataFrame([r for r in texts if r[0] is not None and r[0] >= 1000], TEXT), allowMissingColumns=True)
    got = near_dedup(docs, words=words, percent=percent, frequent=frequent).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        (i, root.get(i), root.get(i) == i) for i, _ in texts)
    sizes = {i: sorted(map(len, s)) for i, s in sets.items()}
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    assert near_dedup(no_docs).count() == 0


def test_near_dedup_of_a_group_around_the_threshold(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]

    def edited(n):
        at = set(rng.sample(range(300), n))
        return " ".join(f"x{rng.random()}" if k in at else w for k, w in enumerate(base))
    rows = [(i, edited(1)) for i in range(30)] + [(i, edited(14)) for i in range(30, 60)]
    made, within = [], near._within_bound
    monkeypatch.setattr(near, "_within_bound", lambda pairs, *a: made.append(pairs.count()) or within(pairs, *a))
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, TEXT), frequent=0).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(60)}
    assert sum(made) <= 5 * len(rows)  # members x outliers would be 900


@pytest.mark.parametrize("per_cell, block", [(8192, 1024), (20, 7)])
def test_embedding_dedup(spark, per_cell, block):
    rng = np.random.default_rng(4)
    rows = [(i, (c + rng.normal(0, 0.03, 6)).tolist(), i % 2) for i, c in enumerate(np.repeat(rng.normal(size=(20, 6)), 8, 0))]
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, rows[0][1], 1), (503, rows[0][1], None),
             (504, None, 0), (505, [], 0), (506, [0.0] * 6, 0), (507, [None] + [1.0] * 5, 0), (508, [math.nan] * 6, 0),
             (509, [math.inf] * 6, 0), (510, [1.0], 0), (511, [5.0], 0), (None, rows[0][1], 0)]
    usable = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v
              and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, v, x in usable for b, w, y in usable if a != b and x == y and len(v) == len(w)
             and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
    root, n = _roots([r[0] for r in rows if r[0] is not None], links), Counter(a for a, _ in links)
    shape = "vec_id bigint, embedding array<double>, label int"
    got = embedding_dedup(spark.createDataFrame(rows, shape), per_cell=per_cell, block=block).collect()
    assert Counter(map(tuple, got)) == Counter((i, n[i], root.get(i), root.get(i) == i) for i, _, _ in rows)
    assert embedding_dedup(spark.createDataFrame([], shape)).count() == 0


def test_suffix_ranks(spark):
    rng = random.Random(3)
    seqs = {i: [rng.randint(1, 2) for _ in range(rng.randint(1, 25))] for i in range(12)}
    seqs[50], seqs[51] = seqs[0], [1] * 20
    symbols = spark.createDataFrame([(s, p, n) for s, v in seqs.items() for p, n in enumerate(v)],
                                    "seq bigint, pos bigint, name bigint")
    suffixes = sorted(v[p:] for v in seqs.values() for p in range(len(v)))
    want = {(s, p): suffixes.index(v[p:]) for s, v in seqs.items() for p in range(len(v))}
    assert {(r.seq, r.pos): r.rank for r in suffix_ranks(symbols, 10 ** 6).collect()} == want
    got = {(r.seq, r.pos): r.rank for r in suffix_ranks(symbols, 4).collect()}
    heads = [seqs[s][p:p + 4] for s, p in sorted(got, key=got.get)]
    assert heads == sorted(heads)
    assert suffix_ranks(symbols.limit(0), 9).count() == 0


def test_substring_dedup(spark, odd_docs, no_docs):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh éü,.") for _ in range(n))
    p, q = text(900), text(600)
    texts = [(20, "a" * 400), (21, "a" * 399), (22, "ab" * 900), (23, text(500) + p[:420] + text(300)), (24, p[100:620]),
             (25, text(50) + p[200:590] + text(700)), (26, p + q), (27, q + text(10) + q[:450]), (None, p[300:] + text(9)),
             (28, ("abcdefghij" * 3 + "k") * 40), (29, text(2000) * 2)]
    for i in range(12):
        t = p + q
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t = t[:at] + text(rng.randint(0, 6)) + t[at + rng.randint(0, 5):]
        texts.append((40 + i, t))
    docs = odd_docs.select("doc_id", "text", "n", "tid", "a").unionByName(spark.createDataFrame(texts, TEXT),
                                                                         allowMissingColumns=True)
    data = [(i, (t or "").encode()) for i, t in [*((i, t) for i, t, _ in TEXTS), *texts]]
    seen = Counter(b[k:k + 400] for _, b in data for k in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        covered = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                covered[k] += 1
                covered[k + 400] -= 1
        gone = np.cumsum(covered)[:len(b)] > 0
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i, len(b), tuple(map(tuple, edges.tolist())), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s.lo, s.hi) for s in r.removed), r.kept_sha256) for r in got) == want
    assert substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("period", [16, 50])
def test_schedules_stay_within_a_block(period):
    blocks = {"a": 900, "b": 130, "c": 17, "d": 1}
    phases, patterns = mixing.schedule(blocks, {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1}, period)
    place, slots = {(p, s, t): at for p, s, t, at in patterns}, {}
    for phase, source, first, end, share, q, start in phases:
        for k in range(first, end):
            slots[start + (k - first) // share * q + place[phase, source, (k - first) % share]] = (phase, source)
    assert sorted(slots) == list(range(sum(blocks.values())))
    seen, begun = Counter(), {}
    for t in range(len(slots)):
        phase, source = slots[t]
        begun.setdefault(phase, t)
        seen[phase, source] += 1
        for p, s, _, _, share, q, _ in phases:
            if p == phase:
                assert abs(seen[p, s] - share / q * (t + 1 - begun[phase])) < 1


def test_mix_places_every_document(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, block_bytes=64, period=8, chunk_rows=2)
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter(
        {(i, s or "") for i, _, s in TEXTS if i != 5} | {(5, "b")}) + Counter([(5, "b")])  # two texts, one of them twice
    slots = sorted((r.slot, r.source_byte, r.source) for r in mixed.collect())
    assert all(len({x[2] for x in slots if x[0] == s}) == 1 for s, _, _ in slots)
    out = mixing.in_order(odd_docs, mixed)
    assert out.columns == odd_docs.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, odd_docs.collect()))
    assert mixing.mix(no_docs).count() == 0


def _furthest(order, weights):
    """How far a source ever is from its share: each slot is shared by weight among the sources that are not used up."""
    names = sorted(weights)
    left, w = np.array([order.count(s) for s in names], float), np.array([float(weights[s]) for s in names])
    want, seen, far = np.zeros(len(names)), np.zeros(len(names)), 0.0
    for s in order:
        room = 1.0
        while room > 1e-12 and (live := left - want > 1e-9).any():
            rate = np.where(live, w, 0) / w[live].sum()
            step = min(room, ((left - want)[live] / rate[live]).min())
            want, room = want + step * rate, room - step
        seen[names.index(s)] += 1
        far = max(far, abs(seen - want).max())
    return far


@pytest.mark.parametrize("sizes, weights", [
    ({"a": 3000, "b": 6000}, {"a": Fraction(1, 3), "b": Fraction(2, 3)}),
    ({"a": 2000, "b": 6, "c": 4}, {"a": 1, "b": 1 / 5000, "c": 0.3}),
    ({"a": 1000} | {f"s{i}": 1 + i % 3 for i in range(1100)}, {"a": 0.33} | {f"s{i}": 0.67 / 1100 for i in range(1100)})])
def test_mixture_stays_within_a_block(spark, sizes, weights):
    """Texts of one byte in blocks of one byte, over many sources and many times the sources."""
    rows = [(i, "x", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, f"{TEXT}, source string")
    got = sorted((r.slot, r.source) for r in mixing.mix(docs, weights, block_bytes=1).collect())
    assert [slot for slot, _ in got] == list(range(len(rows)))
    assert Counter(s for _, s in got) == sizes and _furthest([s for _, s in got], weights) < 1 + 1e-6


def test_stream_of_sources_without_weight():
    got = list(mixing.stream({"a": 2, "b": 2, "c": 0, "z": 2}, {"a": 1, "b": 0, "c": 1, "z": 0}))
    assert got == [("a", 0, 0, 0), ("a", 1, 1, 0), ("b", 0, 2, 1), ("z", 0, 3, 1), ("b", 1, 4, 1), ("z", 1, 5, 1)]
    assert list(mixing.stream({}, {})) == [] and list(mixing.stream({"b": 1}, {"b": 0})) == [("b", 0, 0, 0)]
    with pytest.raises(ValueError):
        list(mixing.stream({"a": 1}, {"a": -1}))


def test_near_dedup_of_ids_with_several_texts(spark):
    """An id is one document: what its texts link with is one component, by the sizes of the texts that link."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (5, a), (5, b), (7, c), (7, " ".join(c.split()[:36])), (8, c), (9, ""), (9, "lone words here"),
            (3, None), (None, a), (10, "lone words here too"), (10, "x")]
    got = near_dedup(spark.createDataFrame(rows, TEXT), words=3, percent=85).collect()
    want = {1: 1, 2: 1, 5: 1, 7: 7, 8: 7, 9: 9, 3: 3, None: None, 10: 10}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, k, i == k) for i, k in want.items()}


def test_embedding_links_of_repeated_ids_and_extreme_sizes(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (1, [1.0, 0.001]), (2, [1.0, -0.001]), (3, [0.001, 1.0]),
            (11, [1e200, 1e200]), (12, [1e-200, 1e-200]), (13, [3e307, 3e307]), (14, [5e-324, 5e-324]), (15, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = embedding_dedup(vectors).collect()
    links = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert links == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (5, 1, 1), (5, 2, 1), *((i, 4, 11) for i in range(11, 16))]


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = [(i, " ".join(f"{'word' if i % 3 else 'WORD!!'}{rng.randint(1, 99)}" for _ in range(rng.randint(5, 60))))
             for i in range(400)]
    docs = spark.createDataFrame(texts, TEXT)
    labels = spark.createDataFrame([(i, min(i % 3, 1)) for i in range(400)] + [(0, None)], "doc_id bigint, quality int")
    got = quality.quality(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == min(r.doc_id % 3, 1) for r in got if r.held_out]) > 0.95
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    odd = quality.quality(odd_docs, labels.limit(0)).collect()
    assert len(odd) == len(TEXTS) and all(r.score == 0.5 and r.predicted == 1 for r in odd)
    assert quality.quality(no_docs, labels).count() == 0


def test_quality_scores_are_those_of_the_tables(spark):
    """Bins found by plain comparison, table entries added one by one."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["word", "WORD!!", "a|b", "x1", "the"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs = spark.createDataFrame(texts + [(300, None)], TEXT)
    labels = spark.createDataFrame([(i, int(t.count("!!") < 8)) for i, t in texts], "doc_id bigint, quality int")
    model = quality.fit_model(docs, labels)
    assert len(model.pairs) == quality.PAIRS
    for r in quality.score(docs, model).collect():
        x = quality.features(r.text)
        at = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts)]
        coarse = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.pair_cuts)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[coarse[i]][coarse[j]] for i, j, t in model.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-12)


def test_shallow_tree_against_all_cuts():
    """Each cut of a boosting step is the best one of all, and a step is the Newton step of its run of bins."""
    rng = np.random.default_rng(6)
    part = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        g, h = rng.normal(size=n), rng.uniform(0.2, 3, n)
        runs = [(0, n)]
        while len(runs) < 3:
            cuts = [(part(g[a:c], h[a:c]) + part(g[c:b], h[c:b]) - part(g[a:b], h[a:b]), -k, -c) for k, (a, b) in enumerate(runs)
                    for c in range(a + 1, b) if h[a:c].sum() >= quality.MIN_HESSIAN and h[c:b].sum() >= quality.MIN_HESSIAN]
            if not cuts or max(cuts)[0] <= 0:
                break
            _, k, c = max(cuts)
            a, b = runs.pop(-k)
            runs += [(a, -c), (-c, b)]
        want = np.zeros(n)
        for a, b in runs:
            want[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        assert quality.shallow_tree(g, h) == pytest.approx(want)


def test_quality_learns_from_one_row_an_id(spark, monkeypatch):
    """Ids that repeat and labels without a document, against a bound on the rows."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((sorted(map(tuple, x)), y.sum())))
    texts = [(0, f"hot {'word ' * n}") for n in range(300)] + [(i, f"text{'!' * i} one") for i in range(3, 90)]
    docs, taught = spark.createDataFrame(texts, TEXT), [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id bigint, quality int")
    one = {i: min(tuple(quality.features(t)) for j, t in texts if j == i) for i in {i for i, _ in texts}}
    quality.fit_model(docs, labels)
    assert seen[0] == (sorted(one[i] for i in taught if i in one), sum(i in one for i in taught)) and 0 in taught
    quality.fit_model(docs, labels, fit_rows=20)
    assert len(seen[1][0]) == 20 and set(seen[1][0]) <= set(seen[0][0])
