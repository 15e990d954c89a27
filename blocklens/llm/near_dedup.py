"""Near dedup by bottom-k sketches of one hash function, without losing a link.

A document is its set of word shingles. Equal sets are merged first (one representative, the smallest id). A sketch
holds the lowest k values of a set in one order for all documents: two sets with similarity t share one of their
lowest n - ceil(t n) + 1 values, so k of that size finds every pair. The order is the hash, with values that many
documents hold put last: which values come last (at most ``FREQUENT``, broadcast) moves work, never a result.

The sketches' values form inverted lists. Linked sets share so many values (``_must_share``) that one of them is followed
by the others when each sketch is put in the order of list length: only such members stay on a list. No list is
expanded into its pairs:
 1. Stars: each list pairs its members with one of them, the pivot. These pairs are verified, and components formed.
 2. Rest: a list whose members are all in one component needs nothing more. Of the others the documents stay that may
    have a partner in another component, told from sizes and counts. Their full sets form lists once more, in order of
    length: a set is listed under its rarest values, those it can do without, so most near copies beyond the threshold
    are on no list. Here the members outside a list's largest component are paired with the members of other components.
Pairs pass the size bound and a bound from the union of both sketches (values known to be shared, plus the most the
unseen rest can add), and the full sets decide. A component's links inside stay unlisted, no link between different
components is missed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from blocklens.llm.common import components, released, stored

WORDS = 5
PERCENT = 80
FREQUENT = 1 << 18
#: Values are looked for that this many texts of a chunk hold; chunks are of this many characters.
FREQUENT_FROM, CHUNK_CHARS = 3, 8_000_000
#: Rows turned into Python objects at once, and hashes of words a task remembers.
ROWS, KNOWN_WORDS = 256, 1 << 16
_LAST = np.uint64(1 << 62)
_MASK = np.uint64((1 << 62) - 1)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 62-bit values of the text's shingles; fewer words are one shingle, none is the empty set."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are \x20 and \x09-\x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, tokens)), np.uint64)
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total ^= (h[i:len(h) - width + 1 + i] + np.uint64(i)) * _FACTORS[i % 8]
        total = (total << np.uint64(23)) | (total >> np.uint64(41))
    total *= _FACTORS[1]
    total ^= total >> np.uint64(29)
    return np.unique(total & _MASK)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _facts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and rows with the values that several texts of a chunk hold."""
        hashes, sets, chars = _WordHashes(), [], 0
        schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                            ("d2", pa.int64())])

        def often():
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            values, counts = values[counts >= FREQUENT_FROM], counts[counts >= FREQUENT_FROM]
            return pa.RecordBatch.from_pydict(
                {"kind": ["often"] * len(values), "id": values.astype(np.int64), "n": counts.astype(np.int64),
                 "d1": [None] * len(values), "d2": [None] * len(values)}, schema=schema)

        for batch in _slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = shingle_set(text, words, hashes)
                digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
                rows.append(("doc", doc_id, len(values), int(digest[0]), int(digest[1])))
                sets.append(values)
                chars += len(text or "")
                if chars >= CHUNK_CHARS:
                    yield often()
                    sets, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)
        if sets:
            yield often()

    return released(run)


def ordered_values(text: str | None, words: int, hashes: _WordHashes, frequent: np.ndarray) -> np.ndarray:
    """The set in the common order: frequent values get bit 62."""
    values = shingle_set(text, words, hashes)
    if len(frequent) and len(values):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        values = np.sort(np.where(frequent[at] == values, values | _LAST, values))
    return values


def _sketches(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in _slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = ordered_values(text, words, hashes, frequent.value)
                n = len(values)
                low = values[:n - -(-percent * n // 100) + 1] if n else values
                rows.append((doc_id, n, int(np.searchsorted(values, _LAST)), int(low[-1]) if n else 0, low.astype(np.int64)))
            names = ("id", "n", "rare", "upto", "low")
            yield pa.RecordBatch.from_pydict(
                dict(zip(names, zip(*rows))) if rows else {c: [] for c in names},
                schema=pa.schema([(c, pa.int64()) for c in names[:-1]] + [("low", pa.list_(pa.int64()))]))

    return released(run)


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in _slices(batches):
            sets = [shingle_set(text, words, hashes).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "full": sets},
                                             schema=pa.schema([("id", pa.int64()), ("full", pa.binary())]))

    return released(run)


def _values(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in _slices(batches):
            sets = [shingle_set(text, words, hashes).astype(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "full": sets}, schema=pa.schema(
                [("id", pa.int64()), ("full", pa.list_(pa.int64()))]))

    return released(run)


def _similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return (100 + percent) * shared >= percent * (a + b)


@F.pandas_udf(LongType())
def _most_shared(low_a: pd.Series, low_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Upper bound of the intersection, from the values up to the end of the shorter-reaching sketch."""
    out = []
    for a, b, n, m in zip(low_a, low_b, n_a.tolist(), n_b.tolist()):
        end = min(a[-1], b[-1])
        a, b = a[:np.searchsorted(a, end, "right")], b[:np.searchsorted(b, end, "right")]
        out.append(len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b)))
    return pd.Series(out, dtype="int64")


@F.pandas_udf(LongType())
def _shared(full_a: pd.Series, full_b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True))
                      for a, b in zip(full_a, full_b)], dtype="int64")


def _within_bound(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link, with both sizes."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("low").alias(f"low_{s}"))
    bound = _most_shared("low_a", "low_b", "n_a", "n_b")
    return stored(pairs.join(side("a"), "a").join(side("b"), "b")
                  .where(_similar(bound, F.col("n_a"), F.col("n_b"), percent))
                  .select("a", "b", "n_a", "n_b").distinct(), "pairs")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are links by their full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(docs.join(wanted, "id", "left_semi").mapInArrow(_full_sets(words), "id bigint, full binary"), "sets")
    full = lambda s: sets.select(F.col("id").alias(s), F.col("full").alias(f"full_{s}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b")
    return stored(both.where(_similar(_shared("full_a", "full_b"), F.col("n_a"), F.col("n_b"), percent))
                  .select("a", "b").distinct(), "links")


def _least(n: Column, m: Column, percent: int) -> Column:
    """The values that sets of n and m values share if they link."""
    return F.ceil((n + m) * percent / (100 + percent))


def _must_share(n: Column, m: Column, shorter: Column, percent: int) -> Column:
    """The values that the sketches of a link share. The one that ends first (of a set of ``shorter`` values) holds all
    values of the other set up to its end but those it does without: n - least of them, of n - ceil(t n) + 1."""
    return 1 + _least(n, m, percent) - F.ceil(shorter * percent / 100)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _may_link(percent: int, other: str) -> Column:
    """Whether two members of a list may link by it, as the first value they share in the order of list length: the
    others they share come ``behind`` it."""
    n, m = F.col("n"), F.col(f"{other}n")
    shorter = F.when(F.col("upto") <= F.col(f"{other}upto"), n).otherwise(m)
    return (_sizes_fit(n, m, percent) & (n <= F.col(f"{other}most")) & (m <= F.col("most"))
            & (F.least("behind", f"{other}behind") >= _must_share(n, m, shorter, percent)))


def _may_link_any(percent: int) -> Column:
    """Whether a member may link with a set of ``lo`` to ``hi`` values. The fewest shared values are asked at an end."""
    n = F.col("n")
    lo = F.greatest("lo", F.ceil(n * percent / 100))
    hi = F.least(F.col("hi"), F.floor(n * 100 / percent), F.col("most"))
    must = lambda m: _must_share(n, m, F.greatest(n, m), percent)
    return (lo <= hi) & (F.col("behind") >= F.least(must(lo), must(hi)))


def _behind(*first: Column) -> Column:
    """How many of a set's listed values come in the order of list length from this one on."""
    return F.row_number().over(W.partitionBy("id").orderBy(*first, F.desc("c"), F.desc("v"))).cast("bigint")


def _undecided(placed: DataFrame, percent: int) -> DataFrame:
    """``id, n, root`` of the members that may link with a member of another root, by the sizes on their lists. Sizes
    that fit lie in the same class of sizes or the next two. What leaves takes others along, so it is done twice."""
    step = max(math.log(100 / percent), 0.01) * (1 + 1e-9) / 2
    placed = placed.withColumn("size", F.floor(F.log("n") / step))
    for _ in range(2):
        there = placed.groupBy("v", "size").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                                F.min("root").alias("r0"), F.max("root").alias("r1"))
        there = there.withColumn("size", F.explode(F.array(*(F.col("size") + k for k in range(-2, 3)))))
        met = placed.join(there, ["v", "size"]).where("root <> r0 OR root <> r1").where(_may_link_any(percent))
        placed = stored(met.select(*placed.columns).distinct(), "undecided")
    return placed.select("id", "n", "root").distinct()


def _between_roots(docs: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``left`` (id, n, root) in different roots that may link by their full sets."""
    sets = docs.join(left.select("id"), "id", "left_semi").mapInArrow(_values(words), "id bigint, full array<bigint>")
    values = stored(sets.select("id", F.explode("full").alias("v")), "values")
    lists = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posts = values.join(lists, "v").join(left, "id").withColumn("behind", _behind())
    posts = stored(posts.where(100 * F.col("behind") >= percent * F.col("n")), "rarest")
    sizes = posts.groupBy("v", "root").agg(F.count(F.lit(1)).alias("m"))
    main = (sizes.groupBy("v").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main"))
            .where("roots > 1").select("v", "main"))
    posts = stored(posts.join(main, "v"), "open")
    outer = posts.where("root <> main").select("v", F.struct("id", "n", "behind", "root").alias("x"))
    n, m = F.col("n"), F.col("x.n")
    return (outer.join(posts, "v").where("x.root <> root AND (root = main OR x.id < id)")
            .where(_sizes_fit(n, m, percent) & (F.least("behind", "x.behind") >= _least(n, m, percent)))
            .select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct())


def near_links(docs: DataFrame, words: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (id, text): ``id, n, d1, d2`` of each row, and ``node, root`` of the linked representatives."""
    spark = docs.sparkSession
    facts = stored(docs.mapInArrow(_facts(words), "kind string, id bigint, n bigint, d1 bigint, d2 bigint"),
                   "facts", "kind")
    top = (facts.where("kind = 'often'").groupBy("id").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "id").limit(frequent).select("id"))
    frequent_values = spark.sparkContext.broadcast(
        np.sort(top.toPandas()["id"].to_numpy(np.int64).astype(np.uint64)))  # at most ``frequent`` values
    rows = facts.where("kind = 'doc'").select("id", "n", "d1", "d2")
    classes = stored(rows.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")),
                     "classes")
    sketches = docs.mapInArrow(_sketches(words, percent, frequent_values),
                               "id bigint, n bigint, rare bigint, upto bigint, low array<bigint>").where("n > 0")
    sketches = stored(sketches.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "sketches")

    posts = sketches.select("id", F.explode("low").alias("v"))
    lists = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posts = posts.join(lists, "v").join(sketches.select("id", "n", "rare", "upto").distinct(), "id")
    # A sketch with a frequent value holds all rarer values of its set. Those on no other list are in no other such
    # set: they bound the size of a partner met on a frequent list, and sets that leave no size at all leave.
    common = F.col("v") >= int(_LAST)
    posts = posts.withColumn("behind", _behind(common.desc())).withColumn(
        "met", F.count_if(~common).over(W.partitionBy("id")))
    most = F.floor((F.col("n") - F.col("rare") + F.col("met")) * (100 + percent) / percent) - F.col("n")
    posts = posts.withColumn("most", F.when(common, most).otherwise(F.lit(1 << 40).cast("bigint")))
    posts = stored(posts.where(F.col("most") * 100 >= F.col("n") * percent).drop("met", "c"), "shared")
    sizes = posts.groupBy("v").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    posts = posts.join(sizes, "v").where(_may_link_any(percent)).drop("lo", "hi")
    lists = (posts.groupBy("v").agg(F.count(F.lit(1)).alias("c"),
                                    F.min(F.struct("rare", "id", "n", "upto", "most", "behind")).alias("p"))
             .where("c > 1"))
    posts = stored(posts.join(lists, "v"), "lists")
    stars = (posts.where("id <> p.id").where(_may_link(percent, "p."))
             .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())
    links = _verified(_within_bound(stars, sketches, percent), docs, words, percent)
    roots = components(links)

    placed = posts.where("c > 2").select("v", "id", "n", "most", "behind").join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "id")), "placed")
    rest = _between_roots(docs, _undecided(placed, percent), words, percent)
    more = _verified(_within_bound(rest, sketches, percent), docs, words, percent)
    if not more.isEmpty():
        roots = components(links.union(more))
    return rows, classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", "n", F.coalesce("root", "rep").alias("root"))


def _one_document(rows: DataFrame, roots: DataFrame, again: DataFrame) -> DataFrame:
    """Rows with their component where ids repeat: ``again`` (key, doc) tells the document of the keys of those rows.
    Components that share a document become one; a row without shingles goes with its document."""
    placed = rows.join(roots, ["d1", "d2", "n"], "left").withColumn(
        "root", F.when(F.col("id").isNotNull(), F.coalesce(F.least("root", "id"), "id")))
    placed = stored(placed.join(again, placed.id == again.key, "left").withColumn("doc", F.coalesce("doc", "id")), "placed")
    least = placed.groupBy("doc").agg(F.min("root").alias("b"))
    joined = components(placed.join(least, "doc").select(F.col("root").alias("a"), "b"))
    placed = placed.join(joined.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").withColumn(
        "root", F.coalesce("up", "root"))
    names = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    return placed.join(names, "root", "left").select(F.col("doc").alias("id"), "n", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS,
               percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words are parted by \\x20 and \\x09-\\x0D, A-Z in lower case; a shingle is ``words`` words, a shorter text is one
    shingle. Rows are linked from ``percent`` per cent of Jaccard similarity on; ``component_id`` is the smallest id
    reachable. Null, empty and blank texts have no shingle and no link. Rows that repeat an id are one document: what
    links with any of them is in one component. Rows without an id link with nothing and stay. Other columns are ignored; an empty table gives an empty
    result."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    twice = stored(texts.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                   .select("id"), "repeated")
    if twice.isEmpty():
        rows, roots = near_links(texts, words, percent, frequent)
        out = rows.join(roots, ["d1", "d2", "n"], "left").withColumn("component_id", F.when(
            F.col("id").isNotNull(), F.coalesce(F.least("root", "id"), "id")))
    else:  # rows of a repeated id get a key of id and text, below all ids
        key = F.coalesce(F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1) - (1 << 62) - (1 << 61), F.col("id"))
        texts = texts.join(twice.withColumn("_again", F.lit(True)), "id", "left").withColumn(
            "key", F.when(F.col("_again"), key).otherwise(F.col("id")))
        again = stored(texts.where("_again").select("key", F.col("id").alias("doc")).distinct(), "keys")
        rows, roots = near_links(texts.select(F.col("key").alias("id"), "text"), words, percent, frequent)
        out = _one_document(rows, roots, again)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
