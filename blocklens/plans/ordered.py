"""Ordered passes (positions, neighbours, running values) over groups of any size.

A plain window over a document puts the whole document into one task. Here a group is cut into chunks
along its order, every chunk is windowed on its own, and only one summary row per chunk is ordered
inside the group; the summary is joined back on the chunk key. A document with a third of all rows
therefore spreads over as many tasks as it has chunks. A chunk of a dense sequence holds any ordinary document whole:
only documents that go beyond their first chunk are read again for a summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import materialise

#: Rows of a chunk of a dense sequence. Ordinary documents are one chunk, so only the few groups beyond it need a summary.
CHUNK_ROWS = 1 << 15
BAND_POINTS = 1024


def chunk_of(seq: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(seq / F.lit(rows)).cast("bigint")


def band_of(y: Column, points: int = BAND_POINTS) -> Column:
    """Vertical band of a page; monotone in y, one band for an ordinary page."""
    return F.floor(y / F.lit(float(points))).cast("bigint")


def dense_positions(df: DataFrame, group: Sequence[str], chunk: dict[str, Column],
                    order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Rank of each row inside its group, beginning at ``start``.

    ``chunk`` maps helper column names to expressions that are monotone in ``order``; they are dropped
    again."""
    names = list(chunk)
    keyed = df.withColumns(chunk)
    keys = [*group, *names]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = keyed.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (inner.join(offsets, keys)
            .withColumn(out, (F.col("_before") + F.col("_rn") - 1 + F.lit(start)).cast("bigint"))
            .drop("_rn", "_before", *names))


def range_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Rank of each row inside its group, for groups of any size and orders of any kind.

    Rows are range-partitioned by group and order, so a large group lies in many partitions; only the number of rows
    of a group in a partition is ordered as a whole. The partitioned rows are checkpointed, as the ranges are sampled
    anew by every job."""
    keyed = materialise(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    return dense_positions(keyed, group, {"_part": F.col("_part")}, order, out, start)


def with_neighbours(df: DataFrame, group: Sequence[str], seq: str, cols: Sequence[str], *,
                    prev: str | None = None, next: str | None = None,
                    rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the previous / next row of a dense sequence as structs of ``cols``.

    The rows at the edge of a chunk are copied into the neighbouring chunk, so one shuffle on
    (group, chunk) is enough. The chunk key stays in the result as ``_chunk``."""
    s = F.col(seq)
    own = chunk_of(s, rows)
    targets = [own]
    if prev:
        targets.append(F.when(s % rows == rows - 1, own + 1))
    if next:
        targets.append(F.when((s % rows == 0) & (own > 0), own - 1))
    spread = (df.withColumn("_own", own)
              .withColumn("_chunk", F.explode(F.array_compact(F.array(*targets)))))
    w = W.partitionBy(*group, "_chunk").orderBy(seq)
    payload = F.struct(*cols)
    add = {}
    if prev:
        add[prev] = F.lag(payload).over(w)
    if next:
        add[next] = F.lead(payload).over(w)
    return spread.withColumns(add).filter(F.col("_chunk") == F.col("_own")).drop("_own")


def known(names: Sequence[str]) -> Column:
    """None of the key columns is null."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in names])


def beyond_first(df: DataFrame, group: Sequence[str], seq: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of groups whose dense sequence goes beyond the first chunk.

    Such a group has more than ``rows`` rows, so there is at most one in ``rows`` rows and their keys are broadcast. Where
    there is none, nothing behind this step runs."""
    large = df.filter(F.col(seq) >= rows).select(*group).distinct()
    return df.join(F.broadcast(large), list(group), "left_semi")


def running_max(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str], value: Column,
                out: str, *, exclusive: bool = False, beyond: DataFrame | None = None) -> DataFrame:
    """Largest non-null ``value`` among the rows up to this one (or before it).

    Rows without a key leave. ``beyond``: the rows of the groups with more than one chunk, where the caller can tell them;
    only they are summarised then."""
    keys = [*group, chunk]
    valued = df.filter(known(keys)).withColumn("_v", value)
    top = (valued if beyond is None else beyond.withColumn("_v", value)).groupBy(*keys).agg(F.max("_v").alias("_top"))
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carry = top.select(*keys, F.max("_top").over(before).alias("_carry"))
    frame = (W.partitionBy(*keys).orderBy(*order)
             .rowsBetween(W.unboundedPreceding, -1 if exclusive else 0))
    inner = valued.withColumn("_in", F.max("_v").over(frame))
    best = F.when(F.col("_in").isNull(), F.col("_carry")).when(
        F.col("_carry").isNull(), F.col("_in")).otherwise(F.greatest("_in", "_carry"))
    if beyond is not None:  # one row in CHUNK_ROWS; a join by shuffle would deal the rows anew
        carry = F.broadcast(carry)
    return inner.join(carry, keys, "left").withColumn(out, best).drop("_v", "_in", "_carry")


def chains(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str], cols: Sequence[str],
           breaks, out: str, *, seq: str | None = None) -> DataFrame:
    """Gaps and islands: ``out`` is struct(order) of the row that opens the run a row belongs to.

    ``breaks(prev, cur)`` compares two consecutive rows given as structs of ``cols``. ``chunk`` is monotone
    in ``order``. Inside a chunk the predecessor is a plain lag; the summary of a chunk holds its first row,
    its last row and its last opening, which settles the rows in front of the chunk's first own opening.

    ``seq`` names a dense sequence that ``chunk`` is the :func:`chunk_of`: only groups with more than one chunk are
    summarised then. The chunk stays in the result as ``_chunk``, with ``_far`` for the rows of such groups."""
    keys = [*group, "_chunk"]
    key, row = F.struct(*order), F.struct(*cols)
    w = W.partitionBy(*keys).orderBy(*order)

    def opened(rows: DataFrame) -> DataFrame:
        d = rows.withColumn("_chunk", chunk).filter(known(keys)).withColumn("_prev", F.lag(row).over(w))
        opens = F.coalesce(breaks(F.col("_prev"), row), F.lit(False))
        return d.withColumn("_open", F.when(opens, key)).drop("_prev")

    d = opened(df)
    ends = (opened(beyond_first(df, group, seq)) if seq else d).groupBy(*keys).agg(
        F.min(F.struct(key.alias("k"), row.alias("r"))).alias("_first"),
        F.max(F.struct(key.alias("k"), row.alias("r"))).alias("_last"), F.max("_open").alias("_top"))
    over = W.partitionBy(*group).orderBy("_chunk")
    ends = ends.withColumn("_before", F.lag("_last").over(over))
    fresh = F.col("_before").isNull() | F.coalesce(
        breaks(F.col("_before.r"), F.col("_first.r")), F.lit(False))
    ends = ends.withColumn("_head", F.when(fresh, F.col("_first.k")))
    carry = F.max(F.coalesce("_top", "_head")).over(over.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*keys, F.coalesce("_head", carry).alias("_start"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    inner = d.withColumn("_in", F.max("_open").over(upto))
    if not seq:
        return inner.join(ends, keys).withColumn(out, F.coalesce("_in", "_start")).drop("_chunk", "_open", "_in", "_start")
    # One row in CHUNK_ROWS; a join by shuffle would deal the rows anew.
    inner = inner.withColumn("_own", F.first(key).over(upto)).join(F.broadcast(ends), keys, "left")
    return inner.withColumns({out: F.coalesce("_in", "_start", "_own"), "_far": F.col("_start").isNotNull()}).drop(
        "_open", "_in", "_start", "_own")
