"""Similarity scores on a 0..100 scale.

Scores against a literal query stay in the JVM: a bit-parallel longest common subsequence folded over the characters,
for queries of any length, and token sets as arrays. Partial scores and scores between two columns are Arrow batches;
a batch scores each distinct string once, so repeated labels cost one computation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS

WORD_BITS = 60


# ---- small helpers used inside tasks ------------------------------------------------------------

def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine word (or big integer) per character of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _score(lcs: int, total: int) -> float:
    return 100.0 * (1.0 - (total - 2 * lcs) / total) if total else 100.0


def ratio_text(a: str, b: str) -> float:
    return _score(lcs_length(a, b), len(a) + len(b))


def partial_ratio_text(a: str, b: str) -> float:
    """Best ratio of the shorter string against every window of the longer, edges included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(s, [t])[0]
    if len(a) == len(b):
        best = max(best, _best_window(t, [s])[0])
    return best


def _best_window(pattern: str, texts: Sequence[str]) -> np.ndarray:
    """Best window score of ``pattern`` (not empty) over texts that are at least as long.

    All windows of all texts are rows of one array and advance together; blanks padded on both sides
    stand for the shorter windows at the edges."""
    m = len(pattern)
    if m > 63:
        return np.array([_best_window_long(pattern, t) for t in texts])
    pad = m - 1
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer(("\0" * pad + ("\0" * pad).join(texts) + "\0" * pad).encode("utf-32-le"),
                          dtype=np.uint32)
    word = np.uint32 if m < 32 else np.uint64
    bits = _mask_table(pattern, int(codes.max()), word)[codes]
    n_windows = lens + pad
    offsets = np.concatenate(([0], np.cumsum(lens + pad)))[:-1]
    owner = np.repeat(np.arange(len(texts)), n_windows)
    first = np.concatenate(([0], np.cumsum(n_windows)))[:-1]
    k = np.arange(int(n_windows.sum())) - first[owner]
    start = offsets[owner] + k
    full = word((1 << m) - 1)
    v = np.full(len(start), full, dtype=word)
    for j in range(m):
        u = v & bits[start + j]
        v = ((v + u) | (v - u)) & full
    lcs = m - np.bitwise_count(v).astype(np.int64)
    size = np.minimum(np.minimum(k + 1, m), lens[owner] + pad - k)
    total = m + size
    score = 100.0 * (1.0 - (total - 2 * lcs) / total)
    return np.maximum.reduceat(score, first)


def _mask_table(pattern: str, top: int, word) -> np.ndarray:
    """Position bits of each character code up to ``top``; the padding code has none."""
    table = np.zeros(top + 1, dtype=word)
    for i, c in enumerate(pattern):
        if 0 < ord(c) <= top:
            table[ord(c)] |= word(1 << i)
    return table


def _best_inside(q: str, texts: Sequence[str]) -> np.ndarray:
    """Best score of texts of one length (at most that of ``q``) against every window of ``q``."""
    n, m = len(texts[0]), len(q)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
    top = int(codes.max())
    best = np.zeros(len(texts))
    for start in range(1 - n, m):
        w = q[max(0, start):start + n]
        table = _mask_table(w, top, np.uint64)
        full = np.uint64((1 << len(w)) - 1)
        v = np.full(len(texts), full, dtype=np.uint64)
        for j in range(n):
            u = v & table[codes[:, j]]
            v = ((v + u) | (v - u)) & full
        lcs = len(w) - np.bitwise_count(v).astype(np.int64)
        total = n + len(w)
        np.maximum(best, 100.0 * (1.0 - (total - 2 * lcs) / total), out=best)
    return best


def _best_window_long(pattern: str, t: str) -> float:
    m, n = len(pattern), len(t)
    spans = [(max(0, s), min(n, s + m)) for s in range(1 - m, n)]
    return max(ratio_text(pattern, t[i:j]) for i, j in spans)


def _per_distinct(s: pd.Series, fn) -> pd.Series:
    """Apply ``fn(list of distinct strings) -> list of scores`` and spread it over the batch."""
    codes, uniq = pd.factorize(s)
    if not len(uniq):
        return pd.Series([None] * len(s), dtype=object)
    scored = list(fn(list(uniq))) + [None]
    return pd.Series([scored[c] for c in codes], index=s.index, dtype=object)


# ---- Column API ---------------------------------------------------------------------------------

def _position_bits(q: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, ch in enumerate(q):
        bits[ch] = bits.get(ch, 0) | (1 << i)
    return bits


def _words_of(bits: int, n: int) -> list[int]:
    return [(bits >> (WORD_BITS * w)) & ((1 << WORD_BITS) - 1) for w in range(n)]


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def lcs(c: Column, q: str, keep: Sequence[Column] | None = None) -> Column:
    """Length of the longest common subsequence of ``c`` and a literal of any length, folded over the characters of
    ``c``. The positions of the literal are bits of as many words as it needs; an addition carries from word to word.
    ``keep`` (one word each) can switch positions off: they then match nothing, as if they were not there."""
    n = -(-len(q) // WORD_BITS)
    full = _words_of((1 << len(q)) - 1, n)
    table = [(ch, _words_of(b, n)) for ch, b in _position_bits(q).items()]
    chars = F.split(c, "")

    if n == 1:
        masks = F.create_map(*[x for ch, b in table for x in (F.lit(ch), _long(b[0]))])

        def step(v: Column, ch: Column) -> Column:
            m = F.coalesce(F.try_element_at(masks, ch), _long(0))
            u = v.bitwiseAND(m if keep is None else m.bitwiseAND(keep[0]))
            return (v + u).bitwiseOR(v - u).bitwiseAND(_long(full[0]))

        return F.lit(len(q)) - F.bit_count(F.aggregate(chars, _long(full[0]), step))

    masks = F.create_map(*[x for ch, b in table for x in (F.lit(ch), F.array(*[_long(w) for w in b]))])
    none = F.array(*[_long(0)] * n)
    limits, kept = F.array(*[_long(w) for w in full]), F.array(*keep) if keep else None
    start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def long_step(v: Column, ch: Column) -> Column:
        m = F.coalesce(F.try_element_at(masks, ch), none)
        u = F.zip_with(v, m, lambda x, y: x.bitwiseAND(y))
        if kept is not None:
            u = F.zip_with(u, kept, lambda x, y: x.bitwiseAND(y))
        rows = F.zip_with(F.zip_with(v, u, lambda x, y: F.struct(x.alias("v"), y.alias("u"))), limits,
                          lambda r, lim: F.struct(r["v"].alias("v"), r["u"].alias("u"), lim.alias("lim")))

        def add(acc: Column, r: Column) -> Column:
            total = r["v"] + r["u"] + acc["carry"]
            word = total.bitwiseOR(r["v"] - r["u"]).bitwiseAND(r["lim"])
            return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.concat(acc["out"], F.array(word)).alias("out"))

        return F.aggregate(rows, start, add)["out"]

    left = F.aggregate(chars, limits, long_step)
    return F.lit(len(q)) - F.aggregate(left, F.lit(0), lambda s, w: s + F.bit_count(w))


def ratio(c: Column, q: str) -> Column:
    """Normalised similarity of ``c`` to a literal."""
    total = F.lit(len(q)) + F.length(c)
    if not q:
        return F.when(c == "", F.lit(100.0)).when(c != "", F.lit(0.0))
    return F.lit(100.0) * (F.lit(1.0) - (total - lcs(c, q) * 2) / total)


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_text(x, y) for x, y in zip(a, b)],
                     dtype="float64")


def ratio_columns(a: Column, b: Column) -> Column:
    return _ratio_udf(a, b)


def partial_ratio(c: Column, q: str) -> Column:
    """Best ratio of the shorter string inside the longer, against a literal."""

    @F.pandas_udf(T.DoubleType())
    def udf(s: pd.Series) -> pd.Series:
        return _per_distinct(s, lambda texts: partial_scores(texts, q)).astype("float64")

    return udf(c)


def partial_scores(texts: Sequence[str], q: str) -> np.ndarray:
    out = np.zeros(len(texts))
    if not q or len(q) > 63:
        out[:] = [partial_ratio_text(q, t) for t in texts]
        return out
    long = [i for i, t in enumerate(texts) if len(t) >= len(q)]
    for part in _pieces(long, texts):
        out[part] = _best_window(q, [texts[i] for i in part])
    by_len: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if 0 < len(t) <= len(q):
            by_len.setdefault(len(t), []).append(i)
    for idx in by_len.values():
        out[idx] = np.maximum(out[idx], _best_inside(q, [texts[i] for i in idx]))
    return out


def _pieces(idx: list[int], texts: Sequence[str], budget: int = 200_000):
    """Split so that one numpy pass never holds more than about ``budget`` windows."""
    part, size = [], 0
    for i in idx:
        if part and size + len(texts[i]) > budget:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


def best_keywords(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<double>: for each group of keywords the best partial ratio, in one Arrow pass."""
    gs = [[k.lower() for k in g] for g in groups]

    @F.pandas_udf("array<double>")
    def udf(s: pd.Series) -> pd.Series:
        def score(texts: list[str]):
            rows = np.stack([np.max([partial_scores(texts, k) for k in g], axis=0) for g in gs])
            return [list(map(float, r)) for r in rows.T]
        return _per_distinct(s, score)

    return udf(F.lower(c))


@F.pandas_udf(T.DoubleType())
def _align_udf(value: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or t is None else _align(v, t) for v, t in zip(value, text)],
                     dtype="float64")


def _align(v: str, t: str) -> float:
    s = max(ratio_text(v, t), partial_ratio_text(v, t))
    return max(s, 85.0) if v in t else s


def alignment_score(value: Column, text: Column) -> Column:
    """How well a value fits a block: best of ratio and partial ratio, 85 at least when contained."""
    return _align_udf(F.lower(value), F.lower(text))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){WS}+"), lambda t: t != "")


def token_sort_ratio(c: Column, q: str) -> Column:
    return ratio(F.array_join(F.sort_array(_tokens(c)), " "), " ".join(sorted(q.split())))


def token_set_ratio(c: Column, q: str) -> Column:
    """Best score of the common tokens, with what either side has beyond them, against each other.

    Tokens are arrays; only what the two sides don't share is compared character by character. Of the literal's
    tokens those not shared are positions that stay switched on in the sorted literal."""
    own = sorted(set(q.split()))
    if not own:
        return F.when(c.isNotNull(), F.lit(0.0))
    whole = " ".join(own)
    n = -(-len(whole) // WORD_BITS)
    theirs = F.array(*[F.lit(t) for t in own])
    places, at = [], 0
    for t in own:
        token = ((1 << len(t)) - 1) << at
        places.append((t, _words_of(token, n), _words_of(token | (1 << at >> 1 if at else 0), n)))
        at += len(t) + 1

    def switches(p: Column) -> Column:
        first = F.get(p["rest"], F.lit(0))
        keep = [reduce(Column.__add__, [F.when(F.array_contains(p["rest"], t), F.when(first == t, _long(alone[w])).otherwise(
            _long(behind[w]))).otherwise(_long(0)) for t, alone, behind in places]) for w in range(n)]
        return F.struct(p.alias("p"), *[k.alias(f"k{w}") for w, k in enumerate(keep)])

    def score(s: Column) -> Column:
        p = s["p"]
        rest, mine, keep = p["rest"], p["mine"], [s[f"k{w}"] for w in range(n)]
        n_a, n_b, sect = F.length(mine), F.length(F.array_join(rest, " ")), p["sect"]
        gap = F.when(sect > 0, 1).otherwise(0)
        la, lb = sect + gap + n_a, sect + gap + n_b
        both = lambda far, size: F.lit(100.0) * (F.lit(1.0) - far / size)
        rests = both(n_a + n_b - lcs(mine, whole, keep) * 2, la + lb)
        return (F.when(p["size"] == 0, 0.0).when((sect > 0) & ((n_a == 0) | (n_b == 0)), 100.0)
                .when(sect == 0, rests).otherwise(F.greatest(rests, both(gap + n_a, sect + la), both(gap + n_b, sect + lb))))

    def parts(t: Column) -> Column:
        shared = F.array_join(F.array_intersect(t, theirs), " ")
        return F.struct(F.size(t).alias("size"), F.length(shared).alias("sect"), F.array_except(theirs, t).alias("rest"),
                        F.array_join(F.sort_array(F.array_except(t, theirs)), " ").alias("mine"))

    # One-element arrays: what a lambda binds is computed once, not for each character.
    bound = F.transform(F.transform(F.transform(F.array(_tokens(c)), parts), switches), score)
    return F.when(c.isNotNull(), F.get(bound, F.lit(0)))


def concept_scores(texts: Column, concepts: Sequence[str]) -> Column:
    """array<double>: for each concept the best token-set ratio over an array of strings."""
    low = F.array_distinct(F.transform(texts, F.lower))

    def best(q: str) -> Column:
        return F.coalesce(F.array_max(F.transform(low, lambda t: token_set_ratio(t, q))), F.lit(0.0))

    return F.array(*[best(c.lower()) for c in concepts])


def keyword_similarity(c: Column, q: str) -> Column:
    """100 on equality, else rounded share of characters that need no edit."""
    a, b = F.lower(c), F.lower(F.lit(q))
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, F.lit(100)).otherwise(
        F.floor(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest) + F.lit(0.5)).cast("int"))


# ---- thresholds, fixed values by query length -----------------------------------------------------

def block_thresholds(q_raw: str, qn: str) -> tuple[int, int]:
    """(partial, ratio) a block must reach."""
    if " " in q_raw.strip():
        return 90, 90
    return (78, 76) if len(qn) <= 5 else (84, 82) if len(qn) <= 7 else (90, 90)


def line_threshold(q_raw: str, qn: str) -> int:
    if " " in q_raw.strip():
        return 92
    return 80 if len(qn) <= 5 else 84 if len(qn) <= 7 else 88


def embedded_threshold(n: int) -> int:
    return 88 if n <= 3 else 82 if n <= 6 else 86


def max_length_delta(n: int) -> int:
    return max(2, n // 2 + 1)
