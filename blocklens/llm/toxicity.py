"""Toxicity by weak supervision.

Many weak voters look at a text: words and word beginnings that stand more often in labelled toxic documents (a
lexicon found in the data, besides words the caller gives), and patterns such as shouting. A generative model with the
true label hidden is fitted to the votes by expectation and maximisation. It estimates how often each voter fires for
either label, and which voters depend on each other: a voter's chance is conditional on one other voter, along the
tree of the largest conditional mutual information. A voter that doesn't fire abstains; that none of the lexicon
fires is a voter too. A given label is one more vote, of an accuracy the model
estimates, so wrong labels can be outvoted and rows without label teach too. The posterior labels then train a linear
classifier on the voters' counts, which scores every document in one scan.

Fitting reads at most ``FIT_ROWS`` labelled rows and ``FREE_ROWS`` rows of any kind, chosen by a hash of their id;
what reaches the driver is votes, not texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import stored

#: Bounds of the sample the models are fitted on.
FIT_ROWS, FREE_ROWS = 20_000, 10_000
#: Lengths of word beginnings, the longest whole word, and voters of the lexicon.
STEMS, LONGEST_WORD, VOTERS = (3, 4, 5, 6), 24, 128
#: A lexicon voter stands in so many labelled toxic documents, is so much likelier in them,
MIN_DOCS, MIN_LIFT = 4, 4.0
#: and so much better explained by the label (log likelihood) than the best of as many tokens by chance.
MIN_GAIN = 5.0
ROUNDS, EDGE = 12, 1e-3
#: A given label is right at least, and at most, so often.
LABEL_TRUST = (0.9, 0.995)

_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]")
PATTERNS = {
    "marks": lambda text, words: text.count("!!"),
    "shout": lambda text, words: int(sum(map(str.isupper, text)) > 0.3 * max(1, len(_LETTERS.findall(text)))),
    "symbols": lambda text, words: int(len(_LETTERS.findall(text)) < 0.5 * len(text)),
    "repeats": lambda text, words: int(len(words) > 8 and 3 * len(set(words)) < len(words)),
    "links": lambda text, words: text.count("://") + text.count("www."),
    "mentions": lambda text, words: text.count("@"),
}


def _tokens(words: set[str]) -> Iterator[tuple[str, str]]:
    """Every word with itself and its beginnings (``stem*``)."""
    for word in words:
        if len(word) <= LONGEST_WORD:
            yield word, word
        for n in STEMS:
            if len(word) >= n:
                yield word, word[:n] + "*"


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Voters:
    """Counts of the voters in a text: lexicon first, then patterns."""

    def __init__(self, lexicon: Sequence[str]):
        self.names = [*lexicon, *PATTERNS]
        self.place = {t: i for i, t in enumerate(lexicon)}
        self.whole = {t: i for t, i in self.place.items() if not t.endswith("*")}
        self.stems = [(n, {t[:-1]: i for t, i in self.place.items() if t.endswith("*") and len(t) == n + 1})
                      for n in sorted({len(t) - 1 for t in lexicon if t.endswith("*")})]

    def counts(self, text: str | None) -> dict[int, int]:
        text = text or ""
        words = _words(text)
        found: dict[int, int] = {}
        for word, n in Counter(words).items():
            if (i := self.whole.get(word)) is not None:
                found[i] = found.get(i, 0) + n
            for size, stems in self.stems:
                if (i := stems.get(word[:size])) is not None:
                    found[i] = found.get(i, 0) + n
        for i, rule in enumerate(PATTERNS.values(), len(self.place)):
            if n := rule(text, words):
                found[i] = n
        return found


# ---- label model --------------------------------------------------------------------------------------------

@dataclass
class LabelModel:
    """P(label), and for each voter P(it fires | its parent, label) as ``chance[j, whether its parent fires, label]``.
    ``parent`` is -1 where a voter depends on the label alone; ``link`` is the dependence's strength."""

    prior: float
    parent: np.ndarray
    link: np.ndarray
    chance: np.ndarray
    trust: np.ndarray
    posterior: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        up = np.where(self.parent >= 0, votes[:, self.parent], 0)
        p = self.chance[np.arange(votes.shape[1]), up]  # row, voter, label
        ratio = np.log(p[..., 1] / p[..., 0])
        return (ratio * (votes > 0)).sum(1) + np.log(self.prior / (1 - self.prior))


def _tree(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each voter in the maximum spanning tree of mutual information given the label."""
    n = votes.shape[1]
    info, total = np.zeros((n, n)), weight.sum()
    v = votes.astype(np.float64)
    for y in (0, 1):
        w = weight[:, y]
        both, one, mass = (v * w[:, None]).T @ v, w @ v, w.sum()
        cells = (both, one[:, None] - both, one - both, mass - one[:, None] - one + both)
        sides = ((one, one), (one, mass - one), (mass - one, one), (mass - one, mass - one))
        for cell, (a, b) in zip(cells, sides):
            cell = np.maximum(cell, 0)
            expected = np.maximum(a[:, None] * b / max(mass, 1e-12), 1e-12)
            info += np.where(cell > 0, cell / total * np.log(np.maximum(cell, 1e-12) / expected), 0)
    np.fill_diagonal(info, -np.inf)
    parent, link = np.full(n, -1), np.zeros(n)
    best, source = np.full(n, -np.inf), np.full(n, -1)
    left = set(range(n))
    while left:  # Prim's, from the voter with the strongest link still open
        j = max(left, key=lambda k: (best[k], -k))
        left.discard(j)
        if best[j] > EDGE:
            parent[j], link[j] = source[j], best[j]
        nearer = info[j] > best
        nearer[[k for k in range(n) if k not in left]] = False
        best[nearer], source[nearer] = info[j][nearer], j
    return parent, link


def fit_labels(votes: np.ndarray, given: np.ndarray) -> LabelModel:
    """``votes`` (rows x voters, 0 or 1; the last voter tells silence and depends on no other), ``given`` labels with -1
    for none; at least one row of either label."""
    known = given >= 0
    share = float(np.clip((given == 1).sum() / max(known.sum(), 1), 1e-3, 1 - 1e-3))
    q = np.where(known, np.where(given == 1, 0.98, 0.02), share)
    trust = np.array([0.95, 0.95])
    n = votes.shape[1]
    model = None
    for turn in range(ROUNDS):
        weight = np.stack([1 - q, q], axis=1)
        if turn == 0:
            weight = weight * known[:, None]  # rows without a label have nothing to say yet
        if turn % 4 == 0:
            parent, link = _tree(votes[:, :-1], weight)
            parent, link = np.append(parent, -1), np.append(link, 0)
        up = np.where(parent >= 0, votes[:, parent], 0)
        chance = np.empty((n, 2, 2))
        alone = (weight.T @ votes + 0.5 * votes.mean(0) + 1e-3) / (weight.sum(0)[:, None] + 0.5 + 2e-3)
        for u in (0, 1):
            there = (up == u).astype(np.float64)
            hits = weight.T @ (there * votes)
            chance[:, u, :] = ((hits + alone) / (weight.T @ there + 1)).T
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        prior = float(np.clip(q[known].mean(), 1e-4, 1 - 1e-4))  # votes without a label don't tell the balance
        if turn:
            for y in (0, 1):
                w = weight[known, y]
                trust[y] = np.clip((w * (given[known] == y)).sum() / max(w.sum(), 1e-9), *LABEL_TRUST)
        model = LabelModel(prior, parent, link, chance, trust.copy())
        odds = model.log_odds(votes)
        said = np.where(given == 1, np.log(trust[1] / (1 - trust[0])), np.log((1 - trust[1]) / trust[0]))
        q = 1 / (1 + np.exp(-np.clip(odds + np.where(known, said, 0), -30, 30)))
    model.posterior = q
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights, the constant last, of a logistic regression on labels that may lie between 0 and 1."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (q - p) - ridge * w)
        size = np.abs(step).max()
        w += step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    labels: LabelModel | None = None

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.voters.names)))
        for i, text in enumerate(texts):
            for j, n in self.voters.counts(text).items():
                x[i, j] = n
        z = np.log1p(x) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---- Spark ----------------------------------------------------------------------------------------------------

def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _lexicon(sample: DataFrame) -> list[str]:
    """Tokens likelier in toxic rows, by the likelihood ratio of their counts. Tokens are counted in toxic rows, those
    in MIN_DOCS of them then in the others; both tables are bounded by the sample."""
    def counts(kept=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            known = kept.value if kept else None
            for batch in batches:
                for text in batch.column(0):
                    own = {t for _, t in _tokens(set(_words(text.as_py())))}
                    seen.update(own if known is None else own & known)
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()),
                                              "n": pa.array(list(seen.values()), pa.int64())})
        return run

    def table(label: int, kept=None):
        rows = sample.where(F.col("label") == label).select("text")
        return rows.mapInArrow(counts(kept), "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return []
    toxic = {r["token"]: r["n"] for r in table(1).where(F.col("n") >= MIN_DOCS).collect()}
    kept = sample.sparkSession.sparkContext.broadcast(set(toxic))
    clean = {r["token"]: r["n"] for r in table(0, kept).collect()}

    def gain(a: int, b: int) -> float:
        out = 0.0
        for hit, rows in ((a, n1), (b, n0)):
            rate = (a + b) / (n1 + n0)
            for k, p in ((hit, rate), (rows - hit, 1 - rate)):
                out += k * np.log(k / (rows * p)) if k else 0.0
        return out

    lifted = [(gain(a, clean.get(t, 0)), t, a, clean.get(t, 0)) for t, a in toxic.items()
              if (a + 0.5) / (n1 + 1) >= MIN_LIFT * (clean.get(t, 0) + 0.5) / (n0 + 1)]
    lifted = [row for row in lifted if row[0] >= np.log(len(toxic)) + MIN_GAIN]
    chosen: list[str] = []
    counted: dict[str, tuple[int, int]] = {}
    for _, token, a, b in sorted(lifted, key=lambda x: (-x[0], len(x[1]), x[1])):
        bare = token.rstrip("*")
        kin = [counted[c] for c in chosen if bare.startswith(c.rstrip("*")) or c.rstrip("*").startswith(bare)]
        if any(k == (a, b) for k in kin):
            continue  # it fires for the rows of a chosen one
        more, spoilt = min(((a - k, b - m) for k, m in kin if k < a), default=(a, b))
        if (more + 0.5) / (n1 + 1) < MIN_LIFT * (spoilt + 0.5) / (n0 + 1):
            continue  # what it fires for beyond a chosen one is not toxic
        chosen.append(token)
        counted[token] = (a, b)
        if len(chosen) == VOTERS:
            break
    return chosen


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic", *, lexicon: Sequence[str] = (), fit_rows: int = FIT_ROWS,
              free_rows: int = FREE_ROWS) -> Model:
    """Null labels are left out; an id with several labels takes the largest, each of its rows is a row of its own as
    far as the bound goes. Without both labels the score is the smoothed share of label 1."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(~held_out("_id"))
    known = (labels.select(F.col(id_col).alias("_id"), (F.col(label_col).cast("int") > 0).cast("int").alias("label"))
             .where(F.col("label").isNotNull() & ~held_out("_id")).groupBy("_id").agg(F.max("label").alias("label")))
    ids = texts.select("_id", F.xxhash64("_id").alias("_h"), F.xxhash64("text").alias("_t"))
    order = ["_h", "_id", "_t"]
    taught = ids.join(known, "_id").orderBy(*order).limit(fit_rows).select("_id", "_t", "label")
    free = ids.orderBy(*order).limit(free_rows).select("_id", "_t", F.lit(-1).alias("label"))
    # Rows alike in id and text are one here; at most fit_rows + free_rows of them, so they can be sent to all tasks.
    asked = taught.union(free).distinct()
    rows = texts.withColumn("_t", F.xxhash64("text")).join(F.broadcast(asked), ["_id", "_t"])
    sample = stored(rows.dropDuplicates(["_id", "_t", "label"]).select("label", "text"), "toxicity-sample")
    voters = Voters(list(dict.fromkeys([*(w.lower() for w in lexicon), *_lexicon(sample)])))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [voters.counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(h) for h in hits], pa.list_(pa.int32())),
                 pa.array([list(h.values()) for h in hits], pa.list_(pa.int32()))], ["label", "voter", "n"])

    seen = sample.mapInArrow(votes, "label int, voter array<int>, n array<int>").toPandas()
    x = np.zeros((len(seen), len(voters.names)))
    for i, (j, n) in enumerate(zip(seen["voter"], seen["n"])):
        x[i, np.asarray(j, int)] = n
    given = seen["label"].to_numpy(int) if len(seen) else np.zeros(0, int)
    order = np.lexsort(np.column_stack([x, given]).T) if len(seen) else []
    x, given = x[order], given[order]  # the fit doesn't depend on the order of rows
    n1, n0 = int((given == 1).sum()), int((given == 0).sum())
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(voters, np.append(np.zeros(len(voters.names)), np.log(share / (1 - share))))
    votes_ = (x > 0).astype(np.int64)
    silent = 1 - votes_[:, :len(voters.place)].max(axis=1, initial=0)
    labelled = fit_labels(np.column_stack([votes_, silent]), given)
    return Model(voters, fit_linear(np.log1p(x), labelled.posterior), labelled)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score (0 to 1, higher for toxic texts) and the prediction (1 from 0.5 on), in place of any
    columns of these names. Null texts count as empty; empty ones are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.voters, model.weights))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string"))).withColumn(
        predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", *, lexicon: Sequence[str] = (), fit_rows: int = FIT_ROWS,
             free_rows: int = FREE_ROWS) -> DataFrame:
    """``id_col, held_out, score, predicted``, one row for each row of ``docs``.

    ``held_out`` rows (crc32 of the id as text, modulo 5, is 0) never teach a model; a null id is not held out and
    teaches nothing. Rows that repeat an id are scored by their own text; texts of any length are read whole. Empty
    tables give an empty result; without labels every score is 0.5. Other columns are not looked at, whatever their
    names."""
    model = fit_model(docs, labels, id_col, text_col, label_col, lexicon=lexicon, fit_rows=fit_rows, free_rows=free_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("_text"))
    return score(rows, model, "_text").select(F.col("_id").alias(id_col), "held_out", "score", "predicted")
