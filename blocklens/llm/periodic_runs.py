"""Runs of repeated words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``min_length``
and at least 2 q words long, that no neighbouring word extends. Spark deals the documents; a task takes a group of
whole documents and

1. compresses their word ids by Re-Pair: pairs that occur more than once become rules, frequent pairs first. All
   occurrences of a round are replaced at once, one that overlaps a more frequent pair waits for the next round;
2. puts a balanced tree over the symbols left of a document, so every stretch of words has one lowest node whose
   boundary it crosses;
3. finds the runs across each boundary once, at one place of its rule: candidate periods come from words before the
   boundary that stand again inside the node, ends from comparing prefix hashes;
4. carries the runs of a rule to all places derived from it, and merges intervals of one period that overlap by a
   period. What is left is compared word by word, so a hash can't make a run.

A group is some ``GROUP_WORDS`` words or one longer document; the work is n log n in its words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
GROUP_WORDS = 1 << 17
#: Rows of one look at candidates or at words under comparison.
CHUNK = 1 << 20
_PRIMES = (2_147_483_647, 2_147_483_629)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers starts[i] .. starts[i] + counts[i] - 1, and i itself."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


class Grammar:
    """Rules of ``ids``, none of them across documents. Nodes have a boundary ``at`` between ``lo`` and ``hi``, given
    at one place of the text; ``places`` of node k, as offsets from its ``lo``, are rows of ``shift`` where ``node``
    is k. The last nodes are those of the trees over the documents' symbols, which stand in one place."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        seq, pos = ids.astype(np.int64), np.arange(len(ids))
        size = np.ones(int(seq.max(initial=0)) + 1, np.int64)
        lo, at, hi, node, place, rules = [], [], [], [], [], 0
        open_ = doc[1:] == doc[:-1]
        while True:
            pairs = np.flatnonzero(open_)
            if not len(pairs):
                break
            codes, which, counts = np.unique(seq[pairs] * len(size) + seq[pairs + 1], return_inverse=True,
                                             return_counts=True)
            rank = np.empty(len(codes), np.int64)  # more frequent pairs rank higher
            rank[np.argsort(counts, kind="stable")] = np.arange(len(codes))
            open_[pairs] = often = counts[which] > 1
            pairs, which = pairs[often], which[often]
            order = np.full(len(seq) + 1, -1)
            order[pairs + 1] = rank[which]  # order[i + 1] belongs to the pair at i
            if not len(pairs):
                break
            mine = rank[which]
            # Pairs of one kind in a row (a word repeated) overlap: every other one, from the first, is taken.
            begins = order[pairs] != mine
            run = np.maximum.accumulate(np.where(begins, pairs, 0))
            taken = (mine >= order[pairs]) & (mine >= order[np.minimum(pairs + 2, len(seq))]) & ((pairs - run) % 2 == 0)
            kept, new = np.unique(which[taken], return_inverse=True)
            twice = np.bincount(new, minlength=len(kept)) > 1
            there = pairs[taken][twice[new]]
            if not len(there):
                break
            new = (np.cumsum(twice) - 1)[new[twice[new]]]
            n = int(twice.sum())
            one = np.empty(n, np.int64)
            one[new[::-1]] = there[::-1]
            left = size[seq[one]]
            length = left + size[seq[one + 1]]
            lo.append(pos[one])
            at.append(pos[one] + left)
            hi.append(pos[one] + length)
            node.append(rules + new)
            place.append(pos[there])
            rules += n
            seq[there] = len(size) + new
            size = np.concatenate([size, length])
            fresh, stay = np.zeros(len(seq), bool), np.ones(len(seq), bool)
            fresh[there], stay[there + 1] = True, False
            seq, pos, fresh = seq[stay], pos[stay], fresh[stay]
            before = np.append(open_, False)[stay][:-1]
            open_ = (doc[pos[1:]] == doc[pos[:-1]]) & (before | fresh[1:] | fresh[:-1])
        if len(seq):
            own = doc[pos]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            many = np.diff(np.append(first, len(seq)))
            start = np.repeat(first, many)
            k = np.arange(len(seq)) - start
            half = k & -k
            inner = np.flatnonzero(k > 0)
            last = np.minimum(k + half, np.repeat(many, many)) - 1 + start
            lo.append(pos[(np.arange(len(seq)) - half)[inner]])
            at.append(pos[inner])
            hi.append(pos[last[inner]] + size[seq[last[inner]]])
            node.append(rules + np.arange(len(inner)))
            place.append(lo[-1])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.lo, self.at, self.hi, self.node = join(lo), join(at), join(hi), join(node)
        self.shift = join(place) - self.lo[self.node]
        self.rules = rules


class _Hashes:
    """Prefix hashes of the word ids modulo two primes, with drawn bases and word values."""

    def __init__(self, ids: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for prime in _PRIMES:
            base = int(draw.integers(1 << 20, prime - 1))
            powers = np.ones(len(ids) + 1, np.int64)
            done = 1
            while done <= len(ids):
                step = min(done, len(ids) + 1 - done)
                powers[done:done + step] = powers[:step] * pow(base, done, prime) % prime
                done += step
            values = draw.integers(1, prime, int(ids.max(initial=0)) + 1)
            self.powers.append(powers)
            self.sums.append(np.append(0, np.cumsum(values[ids] * powers[:-1] % prime)))

    def equal(self, i: np.ndarray, n: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether words i .. i + n - 1 equal those one period on."""
        same = np.ones(len(i), bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            here = (sums[i + n] - sums[i]) % prime * powers[period] % prime
            same &= here == (sums[i + period + n] - sums[i + period]) % prime
        return same


def _longest(fits: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """Largest n of each row, up to ``most``, for which ``fits`` holds; it holds for all smaller ones too."""
    n = np.zeros(len(most), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        more = np.minimum(n + step, most)
        n = np.where(fits(more), more, n)
        step >>= 1
    return n


def _across(g: Grammar, ids: np.ndarray, doc: np.ndarray, seed: int, min_length: int):
    """Intervals (node, start, end, period) with the node's boundary inside, as wide as the node lets them be."""
    gram = min_length - min_length // 2  # so many words in a row equal those one period on, in every run
    n = len(ids) - gram + 1
    none = (np.zeros(0, np.int64),) * 4
    if n <= 0 or not len(g.at):
        return none
    draw = np.random.default_rng(seed + 1)
    values = draw.integers(0, 1 << 63, int(ids.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + values[ids[k:k + n]]
    key[doc[:n] != doc[gram - 1:]] = 0
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1
    again &= key[order] != 0
    order, group = order[again], group[again]  # positions whose words stand again in the document
    if not len(order):
        return none
    own = np.full(len(ids), -1)
    own[order] = group
    places = group * np.int64(len(ids)) + order
    hashes = _Hashes(ids, seed)
    # The words before a boundary, and where they stand again within the node.
    node, word = [], []
    for back in range(1, gram + 1):
        j = g.at - back
        fine = np.flatnonzero((j >= g.lo) & (j + gram <= g.hi))
        fine = fine[own[j[fine]] >= 0]
        node.append(fine)
        word.append(j[fine])
    node, word = np.concatenate(node), np.concatenate(word)
    base = own[word] * np.int64(len(ids))
    first = np.searchsorted(places, base + g.lo[node])
    count = np.searchsorted(places, base + g.hi[node] - gram, "right") - first
    found = []
    ends = np.cumsum(count)
    cuts = np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK)) if len(ends) else []
    for part in np.split(np.arange(len(node)), np.unique(cuts)):
        other, row = _spread(first[part], count[part])
        row = part[row]
        other = order[other]
        period = np.abs(other - word[row])
        k = node[row]
        fine = (period > 0) & (2 * period <= g.hi[k] - g.lo[k])
        k, period, i = k[fine], period[fine], np.minimum(other, word[row])[fine]
        sort = np.lexsort((i, period, k))
        k, period, i = k[sort], period[sort], i[sort]
        # Words that follow each other at one period extend to the same interval.
        one = np.append(True, (k[1:] != k[:-1]) | (period[1:] != period[:-1]) | (i[1:] > i[:-1] + gram))[:len(k)]
        k, period, i = k[one], period[one], i[one]
        before = _longest(lambda m: hashes.equal(i - m, m, period), i - g.lo[k])
        after = _longest(lambda m: hashes.equal(i, m, period), g.hi[k] - period - i)
        start, end = i - before, i + after + period
        fine = (end - start >= np.maximum(min_length, 2 * period)) & (start < g.at[k]) & (g.at[k] < end)
        found.append(np.stack([k, start, end, period])[:, fine])
    k, start, end, period = np.concatenate(found, axis=1)
    # Of several periods of an interval the smallest is its own.
    order = np.lexsort((period, end, start, k))
    k, start, end, period = (x[order] for x in (k, start, end, period))
    one = np.append(True, (k[1:] != k[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(k) else []
    return tuple(x[one] for x in (k, start, end, period)) if len(k) else none


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, n: int):
    """Intervals of one period that overlap by a period become one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    far = np.maximum.accumulate(period * np.int64(n + 1) + end)
    apart = np.append(True, (period[1:] != period[:-1]) | (start[1:] + period[1:] > far[:-1] - period[:-1] * (n + 1)))
    first = np.flatnonzero(apart)
    return start[first], np.maximum.reduceat(end, first), period[first]


def _true(ids: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    long = end - start - period
    ends = np.cumsum(long)
    cuts = np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK)) if len(ends) else []
    for part in np.split(np.arange(len(start)), np.unique(cuts)):
        i, row = _spread(start[part], long[part])
        if (ids[i] != ids[i + period[part][row]]).any():
            return False
    return True


def find_runs(ids: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH):
    """Runs (start, end, period) of word ids; ``doc`` numbers the documents, which stand one after the other."""
    g = Grammar(ids, doc)
    by_node = np.argsort(g.node, kind="stable")
    first = np.searchsorted(g.node[by_node], np.arange(len(g.at)))
    count = np.bincount(g.node, minlength=len(g.at))
    seed = 0
    while True:
        k, start, end, period = _across(g, ids, doc, seed, min_length)
        at, row = _spread(first[k], count[k])
        shift = g.shift[by_node[at]]
        start, end, period = _merged(start[row] + shift, end[row] + shift, period[row], len(ids))
        if _true(ids, start, end, period):
            return start, end, period
        seed += 2  # two texts with one hash: other bases tell them apart


def _collapse(group: list, min_length: int) -> dict[str, list]:
    """Rows of a group of (id, words)."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(words) for _, words in group], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for _, words in group for w in words), np.int64,
                      int(sizes.sum()))
    doc = np.repeat(np.arange(len(group)), sizes)
    start, end, period = find_runs(ids, doc, min_length)
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    keep = np.cumsum(gone)[:-1] == 0
    first = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(start, np.append(first, len(ids)))
    out = {"id": [], "n_words": [], "runs": [], "collapsed": []}
    for d, (key, words) in enumerate(group):
        a, b, o = bounds[d], bounds[d + 1], int(first[d])
        runs = zip((start[a:b] - o).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist())
        kept = words if a == b else [w for w, k in zip(words, keep[o:o + len(words)].tolist()) if k]
        out["id"].append(key)
        out["n_words"].append(len(words))
        out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
        out["collapsed"].append(b" ".join(kept).decode())
    return out


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH,
              rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``id_col, n_words, runs, collapsed``, one row for each row of ``docs``.

    Words are what blanks (space, tab to carriage return) part. ``runs`` holds (start, length, period) by start, then
    period; ``collapsed`` the words, joined by one space, without those a run contains after its first period words.
    ``rewrite`` may return, for an id and a number of words, the word numbers to read instead. Null and blank texts
    have no words, no runs and an empty ``collapsed``; rows that repeat an id are taken one by one; an empty table
    gives an empty result; other columns are not looked at, whatever their names. A text of any length is read whole."""
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    id_type = docs.select(F.col(id_col)).schema[0].dataType
    schema = f"id {id_type.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def out(group: list) -> pa.RecordBatch:
            cols = _collapse(group, min_length)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols["id"], kind), pa.array(cols["n_words"], pa.int64()),
                 pa.array(cols["runs"], pa.list_(run)), pa.array(cols["collapsed"], pa.string())],
                ["id", "n_words", "runs", "collapsed"])

        group, size = [], 0
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                key = key.as_py()
                words = (text.as_py() or "").encode().split()
                other = rewrite(key, len(words)) if rewrite and words else None
                if other is not None:
                    words = [words[i] for i in other.tolist()]
                group.append((key, words))
                size += len(words) + 1
                if size >= GROUP_WORDS:
                    yield out(group)
                    group, size = [], 0
        if group:
            yield out(group)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)
    return found.withColumnRenamed("id", id_col)
