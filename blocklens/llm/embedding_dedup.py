"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Bitwise equal vectors of a label are merged first and counted. Centroids are fitted on a bounded sample; every vector
has the nearest one's cell as its home. Two unit vectors with cosine c are sqrt(2 - 2c) apart, so a vector can only
link with one of another cell if its distance to the plane between both centroids is no larger: it also visits those
cells of a lower number, and no link is lost at a border. A cell is cut into blocks by a hash, and every pair of
blocks is one group of a bounded size, whose cosines are one matrix product in double precision. A group returns, for
each vector, the number of its links and the smallest id of its local component, never pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import components, stored

MIN_COSINE = 0.98
#: At most so many vectors fit the centroids; a centroid for so many distinct vectors, and so many centroids at most.
SAMPLE, PER_CELL, MAX_CELLS = 20_000, 8_192, 2_048
ITERATIONS = 8
BLOCK = 1_024

_VECTOR = "id bigint, label string, dim int, d1 bigint, d2 bigint, vec binary"
_ARROW = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("d1", pa.int64()),
                    ("d2", pa.int64()), ("vec", pa.binary())])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where a vector can link with nothing."""
    for batch in batches:
        rows = []
        for vec_id, label, values in zip(*(c.to_pylist() for c in batch.columns)):
            vec = np.array([np.nan if v is None else v for v in values or ()], np.float64)
            if vec_id is None or label is None or not np.isfinite(vec).all() or not vec.any():
                rows.append((vec_id, label, None, None, None, None))
            else:
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(vec.tobytes()), np.int64).tolist()
                rows.append((vec_id, label, len(vec), d1, d2, vec.tobytes()))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, zip(*rows))), schema=_ARROW)


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.frombuffer(v, np.float64) for v in column])
    _, size = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    rows = np.ldexp(rows, -size)  # by powers of two, exactly: no square over- or underflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centroids(unit: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means on a bounded sample; starts from vectors spread evenly over it."""
    centroids = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)].copy()
    for _ in range(iterations):
        home = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def _placed(centroids, reach: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each vector's home and for each cell of a lower number that it visits."""
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                means = centroids.value.get(dim)
                if means is None or len(means) == 1:
                    yield part.assign(cell=0, visits=False)
                    continue
                near = _unit(part["vec"]) @ means.T
                home = near.argmax(axis=1)
                apart = np.linalg.norm(means[:, None] - means[None], axis=2)
                at, cell = np.nonzero(near[np.arange(len(part)), home][:, None] - near <= reach * apart[home] + 1e-9)
                own = cell == home[at]
                chosen = own | (cell < home[at])
                yield part.iloc[at[chosen]].assign(cell=cell[chosen], visits=~own[chosen])

    return run


def local_roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the component of each row and column of a link matrix."""
    top = np.iinfo(np.int64).max
    a, b = a.copy(), b.copy()
    while True:
        new_a = np.minimum(a, np.where(linked, b[None], top).min(axis=1, initial=top))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compared(min_cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = ~group["visits"] & (group["block"] == group["i"])
        same = not group["other"].iloc[0] and group["i"].iloc[0] == group["j"].iloc[0]
        left = group[first]
        right = left if same else group[~first]
        out = {c: [] for c in ("id", "d1", "d2", "n", "root")}
        if len(left) and len(right):
            u, v = _unit(left["vec"]), _unit(right["vec"])
            linked = u @ v.T >= min_cosine
            if same:
                np.fill_diagonal(linked, False)
            ids = [left["id"].to_numpy(), right["id"].to_numpy()]
            roots = local_roots(linked, *ids)
            sides = ((linked, left, right, roots[0]), (linked.T, right, left, roots[1]))
            for hits, mine, others, root in sides[:1] if same else sides:
                n = hits.astype(np.int64) @ others["copies"].to_numpy()
                for c in ("id", "d1", "d2"):
                    out[c].append(mine[c].to_numpy()[n > 0])
                out["n"].append(n[n > 0])
                out["root"].append(root[n > 0])
        out = pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})
        return out.assign(label=group["label"].iloc[0])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    *, min_cosine: float = MIN_COSINE, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row for each row of ``vectors``.

    Only vectors of equal, non-null labels and equal length are compared. A vector that is null, empty, zero or holds
    a null or non-finite component links with nothing, nor does one without an id (its ``component_id`` is null and it
    stays). Rows that repeat an id are vectors of their own in the counts and one node in the components. Other
    columns are ignored; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stored(rows.mapInArrow(_vectors, _VECTOR), "vectors")
    classes = stored(rows.where("vec IS NOT NULL").groupBy("label", "dim", "d1", "d2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "distinct")

    cells = min(MAX_CELLS, -(-classes.count() // per_cell))
    sample = classes.orderBy(F.xxhash64("d1", "d2"), "id").select("dim", "vec").limit(SAMPLE).toPandas()
    centroids = spark.sparkContext.broadcast(
        {int(dim): fit_centroids(_unit(part["vec"]), max(cells, 1)) for dim, part in sample.groupby("dim")})
    reach = float(np.sqrt(2 - 2 * min_cosine))
    placed = classes.select("id", "label", "dim", "d1", "d2", "copies", "vec").mapInPandas(
        _placed(centroids, reach), "id bigint, label string, dim int, d1 bigint, d2 bigint, copies bigint, vec binary, cell int, visits boolean")
    placed = stored(placed, "placed")

    key = ["label", "dim", "cell"]
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = placed.groupBy(*key).agg(blocks(F.count_if(~F.col("visits"))).alias("own"),
                                     blocks(F.count_if("visits")).alias("guests"))
    dealt = placed.join(sizes, key).withColumn(
        "block", F.pmod(F.xxhash64("id", F.hash("vec")), F.when(F.col("visits"), F.col("guests")).otherwise(F.col("own"))).cast("int"))
    pair = lambda i, j, other: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(other).alias("other"))
    mine = F.col("block")
    among = F.transform(F.sequence(F.lit(0), F.col("own") - 1),
                        lambda k: pair(F.least(mine, k), F.greatest(mine, k), False))
    hosting = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda k: pair(mine, k, True))
    visiting = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: pair(k, mine, True))
    pairs = F.when(F.col("visits"), visiting).otherwise(F.concat(among, hosting))
    groups = dealt.withColumn("_pair", F.explode(pairs)).select(
        *key, "_pair.i", "_pair.j", "_pair.other", "id", "d1", "d2", "copies", "vec", "visits", "block")
    found = stored(groups.groupBy(*key, "i", "j", "other").applyInPandas(
        _compared(min_cosine), "label string, id bigint, d1 bigint, d2 bigint, n bigint, root bigint"), "found")

    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    own = ["label", "id", "d1", "d2"]  # an id may have several vectors
    counts = found.groupBy(*own).agg(F.sum("n").alias("n"))
    classes = (classes.select("label", "dim", "d1", "d2", "id", "copies").join(counts, own, "left")
               .join(roots.withColumnRenamed("node", "id"), "id", "left")
               .select("label", "dim", "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("root", "id").alias("root")))
    out = rows.select("id", "label", "dim", "d1", "d2").join(classes, ["label", "dim", "d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce(F.least("root", "id"), "id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
