"""Compression of vectors to codes: each part of a vector by the nearest entry of its position's codebook.

Codebooks are fitted by rounds of k-means in whole numbers, over metric trees: blocks of vectors get, for each part
position, a tree of balls by the anchors hierarchy. Anchors are chosen far apart and take the points nearest to them;
upwards the balls that fit best merge, downwards each anchor is cut into anchors of its own. A ball caches the sum and
the count of its points. In a round a ball inherits the candidate entries of its parent and drops those that another
is closer than for every point of the ball; a ball with one candidate left is owned whole and gives its cached sums,
only leaves that stay undecided look at points. Trees are built once and stored; a round reads them, and a few
numbers an entry and partition come back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one block, most points of a leaf, and pieces a label's rows are summed and joined in.
BLOCK, LEAF, SALTS = 4_096, 64, 64


# ---- trees ---------------------------------------------------------------------------------------------

def _square(d: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", d, d)


def _anchors(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots of up to ``k`` anchors, the anchor of each point, and the anchors' radii. The next anchor is the point
    farthest from its own; only points farther from theirs than half way to the new one can change over."""
    dist = np.sqrt(_square(at - at[0]))
    pivots = np.empty((k, at.shape[1]))
    pivots[0] = at[0]
    owner = np.zeros(len(at), np.int64)
    n = 1
    while n < k:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        half = np.sqrt(_square(pivots[:n] - at[far])) * (0.5 - 1e-12)
        may = np.flatnonzero(dist > half[owner])
        closer = np.sqrt(_square(at[may] - at[far]))
        won = closer < dist[may]
        may = may[won]
        owner[may], dist[may] = n, closer[won]
        pivots[n] = at[far]
        n += 1
    radius = np.zeros(n)
    np.maximum.at(radius, owner, dist)
    return pivots[:n], owner, radius


def _node(points: np.ndarray, members: np.ndarray):
    """A leaf's members, or a pair of nodes."""
    if len(members) <= LEAF:
        return members
    centre, owner, radius = _anchors(points[members], max(2, isqrt(len(members))))
    k = len(centre)
    if k == 1:  # all alike
        return members
    by_owner = members[np.argsort(owner, kind="stable")]
    weight = np.bincount(owner).astype(float)
    nodes = [_node(points, g) for g in np.split(by_owner, np.cumsum(weight[:-1]).astype(int))]
    wide = np.sqrt(_square(centre[:, None] - centre[None])) + radius[:, None] + radius
    np.fill_diagonal(wide, np.inf)
    for _ in range(k - 1):
        i, j = divmod(int(wide.argmin()), k)
        nodes[i] = (nodes[i], nodes[j])
        radius[i], total = wide[i, j] / 2, weight[i] + weight[j]
        centre[i] += (centre[j] - centre[i]) * (weight[j] / total)
        weight[i] = total
        wide[j] = wide[:, j] = np.inf
        row = np.sqrt(_square(centre - centre[i])) + radius + radius[i]
        row[i] = np.inf
        wide[i] = wide[:, i] = np.where(np.isinf(wide[i]), np.inf, row)
    return nodes[i]


class Tree:
    """Balls over points in ball order: ``order`` gives their place in the block, ball b has points start[b] to
    end[b] and the children left[b], right[b] (-1 for a leaf)."""

    def __init__(self, points: np.ndarray):
        spans, order, todo = [], [], [(_node(points.astype(np.float64), np.arange(len(points))), -1, 0)]
        placed = 0
        while todo:
            node, parent, side = todo.pop()
            b = len(spans)
            spans.append([placed, placed, -1, -1, parent])
            if parent >= 0:
                spans[parent][2 + side] = b
            if isinstance(node, tuple):
                todo += [(node[1], b, 1), (node[0], b, 0)]
            else:
                order.append(node)
                placed += len(node)
                spans[b][1] = placed
        for b in range(len(spans) - 1, 0, -1):  # children come after their parent
            up = spans[b][4]
            spans[up][1] = max(spans[up][1], spans[b][1])
        table = np.array(spans, np.int64)
        self.start, self.end, self.left, self.right = table[:, 0], table[:, 1], table[:, 2], table[:, 3]
        self.order = np.concatenate(order)
        self.points = points[self.order]
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sums = upto[self.end] - upto[self.start]
        self.centre = self.sums / (self.end - self.start)[:, None]
        row, ball = _ranges(self.start, self.end)
        away = _square(self.points[row] - self.centre[ball])
        self.radius = np.sqrt(np.maximum.reduceat(away, np.cumsum(self.end - self.start) - (self.end - self.start)))

    def pack(self) -> bytes:
        """Points and sums as long, the rest as double and int; a vector's own numbers fit a long by the limit."""
        head = np.array([len(self.order), len(self.start), self.points.shape[1]], np.int64)
        small = np.abs(self.points).max(initial=0) < 2 ** 31
        links = np.concatenate([self.order, self.start, self.end, self.left, self.right]).astype(np.int32)
        return b"".join([head.tobytes(), bytes([int(small)]), links.tobytes(),
                         self.points.astype(np.int32 if small else np.int64).tobytes(), self.sums.tobytes(),
                         self.radius.tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        t = object.__new__(cls)
        n, balls, width = np.frombuffer(data, np.int64, 3).tolist()
        small, at = data[24], 25
        links = np.frombuffer(data, np.int32, n + 4 * balls, at).astype(np.int64)
        at += 4 * len(links)
        t.order, t.start, t.end, t.left, t.right = np.split(links, n + balls * np.arange(4))
        t.points = np.frombuffer(data, np.int32 if small else np.int64, n * width, at).astype(np.int64).reshape(n, width)
        at += n * width * (4 if small else 8)
        t.sums = np.frombuffer(data, np.int64, balls * width, at).reshape(balls, width)
        t.radius = np.frombuffer(data, np.float64, balls, at + balls * width * 8)
        t.centre = t.sums / (t.end - t.start)[:, None]
        return t


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each start .. end - 1, and the index of their range."""
    size = end - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - (np.cumsum(size) - size - start)[owner], owner


def assign(tree: Tree, book: np.ndarray, want_codes: bool):
    """Sums and counts of the points nearest to each entry of ``book`` (ties to the lower index), and the entry of
    each point in ball order if wanted."""
    k, width = book.shape
    sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    codes = np.zeros(len(tree.order), np.int64) if want_codes else None
    real = book.astype(np.float64)
    apart = np.sqrt(_square(real[:, None] - real[None]))
    _, once = np.unique(book, axis=0, return_index=True)  # of equal entries only the first wins
    balls, lists = np.zeros(1, np.int64), np.zeros((1, k), bool)
    lists[0, once] = True
    while len(balls):
        d = _square(tree.centre[balls][:, None] - real[None])
        open_d = np.where(lists, d, np.inf)
        best = open_d.argmin(1)
        lead = d - d[np.arange(len(balls)), best][:, None]
        slack = 2 * tree.radius[balls][:, None] * apart[best]
        lists = lists & (lead <= slack + 1e-9 * (1 + d + slack))  # rounding never drops an entry
        whole = lists.sum(1) == 1
        owner = best[whole]
        np.add.at(sums, owner, tree.sums[balls[whole]])
        np.add.at(counts, owner, tree.end[balls[whole]] - tree.start[balls[whole]])
        if want_codes:
            row, ball = _ranges(tree.start[balls[whole]], tree.end[balls[whole]])
            codes[row] = owner[ball]
        leaf = ~whole & (tree.left[balls] < 0)
        if leaf.any():
            row, ball = _ranges(tree.start[balls[leaf]], tree.end[balls[leaf]])
            which, entry = np.nonzero(lists[leaf])
            size = np.bincount(which, minlength=int(leaf.sum()))
            first = np.cumsum(size) - size
            pair, point = _ranges(first[ball], first[ball] + size[ball])
            away = _square(tree.points[row][point] - book[entry[pair]])
            begin = np.cumsum(size[ball]) - size[ball]
            least = np.minimum.reduceat(away, begin)
            near = np.minimum.reduceat(np.where(away == least[point], entry[pair], k), begin)
            np.add.at(sums, near, tree.points[row])
            counts += np.bincount(near, minlength=k)
            if want_codes:
                codes[row] = near
        down = ~whole & ~leaf
        balls, lists = (np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]),
                        np.concatenate([lists[down], lists[down]]))
    return sums, counts, codes


# ---- Spark -----------------------------------------------------------------------------------------------

def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE x) of each component; null where the vector can't be coded."""
    for batch in batches:
        out = []
        for values in batch.column(2).to_pylist():
            vec = np.array([np.nan if v is None else v for v in values], np.float64) if values else np.zeros(0)
            width = len(vec) // PARTS
            fine = len(vec) and len(vec) % PARTS == 0 and np.isfinite(vec).all()
            limit = isqrt((2 ** 63 - 1) // max(len(vec), 1)) // 2
            fine = fine and width and np.abs(vec).max() < limit / SCALE - 1
            out.append(np.floor(vec * SCALE).astype(np.int64).tobytes() if fine else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                         ["id", "label", "vec"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for up to BLOCK vectors: their ids, labels and a packed tree for each part."""
    def out(rows: list, kinds: list) -> pa.RecordBatch:
        block = np.stack([np.frombuffer(v, np.int64) for _, _, v in rows])
        trees = [Tree(part).pack() for part in np.split(block, PARTS, axis=1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([[r[0] for r in rows]], pa.list_(kinds[0])), pa.array([[r[1] for r in rows]], pa.list_(kinds[1])),
             pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    rows, kinds = [], []
    for batch in batches:
        kinds = [batch.column(0).type, batch.column(1).type]
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            if len(rows) == BLOCK:
                yield out(rows, kinds)
                rows = []
    if rows:
        yield out(rows, kinds)


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the parts nearest to each entry: at most PARTS x ENTRIES rows reach the driver."""
    width = books[0].shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, len(shared.value[0]), width), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, data in enumerate(trees):
                    s, n, _ = assign(Tree.unpack(data.as_py()), shared.value[p], False)
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
             pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    rows = blocks.select("trees").mapInArrow(near, "part int, entry int, n bigint, s array<bigint>")
    total = rows.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]).alias("s"))
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["s"]]) for r in total.collect()}


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 *, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256``, one row for each vector that can be coded.

    Each component x becomes floor(256 x); vectors are cut into 16 equal parts. A codebook starts as that part of the
    ``entries`` smallest ids' vectors (rows of one id in the order of their components, a null id last; all vectors if there are
    fewer). In each round every part goes to the nearest entry, the lower index on ties, and an entry becomes the
    floor of the mean of its parts; entries without parts stay. ``code`` has two hex digits a part, ``error`` is the
    squared distance, ``label_error`` its sum over the rows of the label (nulls together; null beyond a long).

    Not coded are null vectors, those with null or non-finite components, those whose length isn't a multiple of 16 or
    isn't that of the first coded one, and those so large that a squared distance leaves a long (2^63 in all). An
    empty table gives an empty result; other columns are not looked at, whatever their names."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vec"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:2]]
    whole = (rows.mapInArrow(_whole_numbers, f"id {kinds[0]}, label {kinds[1]}, vec binary").where("vec IS NOT NULL"))
    result = f"id {kinds[0]}, label {kinds[1]}, code string, error bigint"
    components = lambda v: np.frombuffer(v, np.int64).tolist()

    # The smallest ids: ties of the last one are all looked at, in the order of their components.
    heads = whole.select("id", "vec", F.length("vec").alias("n"))
    lead = heads.orderBy(F.asc_nulls_last("id"), "n", "vec").limit(1).collect()  # one row
    if not lead:
        empty = spark.createDataFrame([], result)
        return empty.select(F.col("id").alias(id_col), "code", "error", F.col("error").alias("label_error"),
                            F.lit(None).cast("string").alias("codebooks_sha256"))
    size = lead[0]["n"]
    whole = whole.where(F.length("vec") == size)
    signed = F.udf(components, "array<bigint>")
    order = [F.asc_nulls_last("id")]
    first = whole.select("id", "vec").orderBy(*order).limit(entries)
    last = first.agg(F.max(F.struct(F.col("id").isNull(), "id")).alias("m")).collect()[0]["m"]
    low = whole.select("id", "vec")
    if last[1] is not None:
        low = low.where(F.col("id") <= F.lit(last[1]))
    if low.groupBy("id").count().where("count > 1").isEmpty():
        start = low.orderBy(*order).limit(entries).select("vec").collect()
    else:
        start = low.withColumn("v", signed("vec")).orderBy(*order, "v").limit(entries).select("vec").collect()
    first_vectors = np.array([components(r["vec"]) for r in start], np.int64)
    books = np.split(first_vectors, PARTS, axis=1)

    blocks = stored(whole.mapInArrow(_trees, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<binary>"),
                    "vector-trees")
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for (p, entry), (n, total) in _sums(blocks, books).items():
            books[p][entry] = [s // n for s in total]
    shared = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns):
                code = np.zeros((len(ids), PARTS), np.uint8)
                error = np.zeros(len(ids), np.int64)
                for p, data in enumerate(trees):
                    tree = Tree.unpack(data.as_py())
                    _, _, own = assign(tree, shared.value[p], True)
                    code[tree.order, p] = own
                    error[tree.order] += _square(tree.points - shared.value[p][own])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([bytes(c).hex() for c in code]), pa.array(error)],
                    ["id", "label", "code", "error"])

    coded = stored(blocks.mapInArrow(codes, result), "vector-codes")
    # A label's rows are summed in pieces, and a piece takes the label's sum to its rows: no label is one task's.
    salted = coded.withColumn("piece", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    pieces = salted.groupBy("label", "piece").agg(F.try_sum(F.col("error").cast("decimal(38,0)")).alias("e"))
    labels = pieces.groupBy("label").agg(F.sum("e").alias("label_error"))
    pieces = pieces.select(F.col("label").alias("l"), F.col("piece").alias("p"))
    pieces = pieces.join(labels, pieces.l.eqNullSafe(labels.label)).select(
        "l", "p", F.col("label_error").try_cast("bigint").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    out = salted.join(pieces, salted.label.eqNullSafe(pieces.l) & (salted.piece == pieces.p))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
