"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; at each visit a shallow tree over the feature's bins adds a small step to
its lookup table. When the single tables are fitted, the feature pairs that explain most of the remaining error get
tables of their own, boosted in the same way. A score is the sum of table entries, looked up for a whole batch at once.
The model is fitted on the driver from the features of at most ``FIT_ROWS`` labelled rows; scoring is one scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import released

#: The model is fitted on at most so many labelled rows, chosen by a hash of their id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.1, 3
MIN_HESSIAN = 2.0

FEATURES = ("bytes", "words", "word_length", "upper", "ascii_marks", "mark_runs", "shouts", "bars", "digits",
            "other_bytes", "blanks", "distinct_words", "top_word", "distinct_lines", "line_words", "stop_words",
            "capital_words", "sentence_words")


def features(text: str | None) -> list[float]:
    """Figures of a whole text in the order of ``FEATURES``; all zero for an empty one."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    blanks = int(hist[9:14].sum() + hist[32])
    marks = int(hist[33:127].sum()) - upper - lower - digits
    words = data.split()
    count, lines = Counter(words), data.split(b"\n")
    w = max(len(words), 1)
    runs = sum(data.count(3 * c) for c in (b"#", b"$", b"%", b"&", b"*"))
    ends = int(hist[46] + hist[33] + hist[63])
    return [np.log1p(n), np.log1p(len(words)), (n - blanks) / w, upper / max(upper + lower, 1), marks / n, runs / w,
            data.count(b"!!") / w, int(hist[124]) / w, digits / n, int(hist[128:].sum()) / n, blanks / n,
            len(count) / w, max(count.values(), default=0) / w, len(set(lines)) / len(lines),
            np.log1p(len(words) / len(lines)), sum(c for x, c in count.items() if len(x) <= 3) / w,
            sum(c for x, c in count.items() if 65 <= x[0] <= 90) / w, np.log1p(len(words) / max(ends, 1))]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(text) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": batch.column(0), "label": batch.column(1), "x": rows},
                                         schema=pa.schema([("n", pa.int64()), ("label", pa.int32()),
                                                           ("x", pa.list_(pa.float64()))]))


@dataclass
class Model:
    """``base`` plus one table entry a feature and one a pair; all tables together are a few kilobytes."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _split(grad: np.ndarray, hess: np.ndarray) -> tuple[int, float]:
    """Best cut of a run of bins and its gain (0 if there is none)."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    rest_g, rest_h = grad.sum() - g, hess.sum() - h
    fine = (h >= MIN_HESSIAN) & (rest_h >= MIN_HESSIAN)
    if not fine.any():
        return 0, 0.0
    gain = np.where(fine, g ** 2 / (h + 1) + rest_g ** 2 / (rest_h + 1) - grad.sum() ** 2 / (hess.sum() + 1), -1)
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Step of each bin: Newton steps of at most ``leaves`` runs of bins, cut where the gain is largest."""
    runs = [(0, len(grad))]
    while len(runs) < leaves:
        cuts = [(_split(grad[a:b], hess[a:b]), k) for k, (a, b) in enumerate(runs)]
        (at, gain), k = max(cuts, key=lambda c: c[0][1])
        if gain <= 0:
            break
        a, b = runs.pop(k)
        runs += [(a, a + at), (a + at, b)]
    step = np.zeros(len(grad))
    for a, b in runs:
        step[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return step


def _grid_step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """As ``shallow_tree`` on a grid: one cut along the first side, then one along the other in each half."""
    step = np.zeros_like(grad)
    at, _ = _split(grad.sum(axis=1), hess.sum(axis=1))
    for rows in (slice(0, at), slice(at, None)) if at else (slice(0, None),):
        step[rows] = shallow_tree(grad[rows].sum(axis=0), hess[rows].sum(axis=0), 2)
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without both labels in ``y`` the model is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1] if len(x) else len(FEATURES)
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * width, [np.zeros(1)] * width,
                  [np.zeros(0)] * width, [])
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [_cuts(x[:, j], BINS) for j in range(width)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)
    chance = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for j, own in enumerate(bins):
            p = chance()
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size))
            model.tables[j] += step
            total += step[own]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grids(i, j, p):
        cell, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        n = sizes[i] * sizes[j]
        return cell, np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape)

    p = chance()
    gains = []
    for i, j in combinations(range(width), 2):
        _, g, h = grids(i, j, p)
        gains.append((float((_grid_step(g, h) * g).sum()), i, j))
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            cell, g, h = grids(i, j, chance())
            step = RATE * _grid_step(g, h)
            table += step
            total += step.ravel()[cell]
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", *, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled documents that are not held out, ``fit_rows`` of them at most. Null labels are left out; an
    id with several labels takes the largest, one with several texts the smallest row of features."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where(F.col("_label").isNotNull() & ~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label")))
    there = docs.select(F.col(id_col).alias("_id")).distinct()
    known = known.join(there, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(known.withColumn("_n", F.monotonically_increasing_id())), "_id")  # at most fit_rows ids
    sample = (rows.select("_n", "_label", "_text").mapInArrow(_feature_rows, "n bigint, label int, x array<double>")
              .groupBy("n", "label").agg(F.min("x").alias("x")).toPandas())
    if sample.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.lexsort(np.stack(sample["x"]).T)  # the fit doesn't depend on the order of rows
    return fit(np.stack(sample["x"])[order], (sample["label"].to_numpy() > 0).astype(float)[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score (0 to 1, higher for good texts) and the prediction (1 from 0.5 on), in place of any
    columns of these names. Null texts count as empty; empty ones are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(np.array([features(t) for t in texts], np.float64)
                                               .reshape(len(texts), len(FEATURES))))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return released(rows)(batches)

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string"))).withColumn(
        predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", *, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id_col, held_out, score, predicted``, one row for each row of ``docs``.

    ``held_out`` rows (crc32 of the id as text, modulo 3, is 1) never teach the model; a null id is not held out and
    has no label. Rows that repeat an id are scored by their own text. Empty tables give an empty result; without
    labels every score is 0.5."""
    model = fit_model(docs, labels, id_col, text_col, label_col, fit_rows=fit_rows)
    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("_text"))
    return score(rows, model, "_text").drop("_text")
