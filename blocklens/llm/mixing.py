"""Mixing sources to target weights by Pfair scheduling.

A source's texts, in hash order, are a stream cut into blocks of ``BLOCK_BYTES``. In the ideal stream every source
that is not used up gets its exact weight of each slot, divided by the weights of those left. Its block k is released
in the slot where the ideal stream begins it, and due where that ends it; of the released blocks the one due first
takes the next slot. On one output stream this meets all deadlines, so at every slot of the whole stream each source is
less than one block away from its ideal share, whatever the weights and however many sources run out on the way.

With weights w and n blocks a source, the ideal stream has placed sum(min(w v, n)) blocks when each source has got its
weight v times, so block k begins at v = k / w: integers on a common denominator, nothing is rounded. The driver walks
the slots once, keeps one block a source, and writes the slots in pieces to a table that the documents join.

Positions in a source are prefix sums over hash chunks: a source with a third of all rows is many chunks, only chunk
totals are ordered as a whole."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import row_key, shared_folder, stored

BLOCK_BYTES = 1 << 16
CHUNK_ROWS = 1 << 14
#: Slots written at once.
PIECE = 1 << 17
#: With a period, the schedule of so many slots at most, over all phases, is made and broadcast (24 bytes each).
MAX_PATTERN = 1 << 20


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Blocks of each source in a period: at least one, the rest by largest remainders."""
    if len(weights) > period:
        raise ValueError("the period needs a slot for each source")
    total, free = sum(weights.values()), period - len(weights)
    exact = {s: w / total * period for s, w in weights.items()}
    spare = {s: max(0.0, x - 1) for s, x in exact.items()}
    scale = free / (sum(spare.values()) or 1)
    out = {s: 1 + int(x * scale) for s, x in spare.items()}
    by_rest = sorted(weights, key=lambda s: (-(spare[s] * scale % 1), s))
    for k in range(period - sum(out.values())):
        out[by_rest[k % len(by_rest)]] += 1
    return out


def pattern(share: Mapping[str, int]) -> list[str]:
    """Source of each slot of a period: earliest deadline first among released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * period // share[s], s, k + 1))
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> tuple[list[tuple], list[tuple]]:
    """Phase rows ``phase, source, first_block, end_block, share, period, first_slot`` and pattern rows
    ``phase, source, turn, slot`` for sources that have so many blocks."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, slot, phases, patterns = dict.fromkeys(left, 0), 0, [], []
    while left:
        share = shares({s: weights[s] for s in left}, period)
        if len(patterns) + period > MAX_PATTERN:
            raise ValueError("too many phases for the bound on pattern rows: use a shorter period")
        phase, turns = len(phases) and phases[-1][0] + 1, pattern(share)
        whole = min(n // share[s] for s, n in left.items())
        used, length = {s: whole * share[s] for s in left}, whole * period
        for s in turns:
            if used[s] == left[s]:
                break
            used[s] += 1
            length += 1
        seen = dict.fromkeys(left, 0)
        for t, s in enumerate(turns):
            patterns.append((phase, s, seen[s], t))
            seen[s] += 1
        for s in left:
            phases.append((phase, s, done[s], done[s] + used[s], share[s], period, slot))
            done[s] += used[s]
        slot += length
        left = {s: n - used[s] for s, n in left.items() if n > used[s]}
    return phases, patterns


def stream(blocks: Mapping[str, int], weights: Mapping[str, Fraction | float]) -> Iterator[tuple[str, int, int, int]]:
    """``source, block, slot, phase`` of every slot, for sources that have so many blocks; ``phase`` counts the times
    at which the ideal stream has used up a source. Sources of weight 0 follow after all others, in equal shares."""
    left = {s: n for s, n in blocks.items() if n > 0}
    exact = {s: Fraction(weights[s]) for s in left}
    if min(exact.values(), default=0) < 0:
        raise ValueError("a weight is negative")
    first = {s: n for s, n in left.items() if exact[s]}
    if len(first) < len(left):
        slots = phase = -1
        for s, k, slots, phase in stream(first, weights) if first else ():
            yield s, k, slots, phase
        rest = {s: n for s, n in left.items() if not exact[s]}
        for s, k, slot, p in stream(rest, dict.fromkeys(rest, 1)):
            yield s, k, slot + slots + 1, p + phase + 1
        return
    names = sorted(left)
    unit = math.lcm(*(exact[s].denominator for s in names))
    n, w = [left[s] for s in names], [int(exact[s] * unit) for s in names]
    # Phase j: the ideal stream has placed base + active v blocks, until v = n / w of the sources used up at its end.
    ends, bounds, base, active = [], [], [0], [sum(w)]
    for v, used in itertools.groupby(sorted(range(len(n)), key=lambda i: Fraction(n[i], w[i])),
                                     key=lambda i: Fraction(n[i], w[i])):
        used = list(used)
        ends.append((v.numerator, v.denominator))
        bounds.append(math.ceil(base[-1] + active[-1] * v))
        base.append(base[-1] + sum(n[i] for i in used))
        active.append(active[-1] - sum(w[i] for i in used))
    at = [0] * len(n)  # phase of the end of each source's next block

    def due(i: int, k: int) -> tuple[int, int]:
        """Slots in which the ideal stream has ended block k of source i, rounded down and up."""
        lo, hi = at[i], len(ends) - 1
        if (k + 1) * ends[lo][1] > ends[lo][0] * w[i]:
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if (k + 1) * ends[mid][1] > ends[mid][0] * w[i] else (lo, mid)
            at[i] = lo
        whole, rest = divmod(active[lo] * (k + 1), w[i])
        return base[lo] + whole, base[lo] + whole + (rest > 0)

    waiting: list[tuple[int, int, int]] = []  # release, source, block
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release of the next block
    begin = [(0, i, 0) for i in range(len(n))]
    phase = 0
    for slot in range(sum(n)):
        while begin or waiting and waiting[0][0] <= slot:
            _, i, k = begin.pop() if begin else heapq.heappop(waiting)
            free, end = due(i, k)
            heapq.heappush(ready, (end, i, k, free))
        _, i, k, free = heapq.heappop(ready)
        while slot >= bounds[phase]:
            phase += 1
        yield names[i], k, slot, phase
        if k + 1 < n[i]:
            heapq.heappush(waiting, (free, i, k + 1))


def _slots(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, Fraction | float]) -> DataFrame:
    """The rows of :func:`stream` as a table ``_source, _block, slot, phase``, written piece by piece."""
    path, shape = f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}", "_source string, _block bigint, slot bigint, phase int"
    rows = stream(blocks, weights)
    piece = list(itertools.islice(rows, PIECE))
    spark.createDataFrame(piece[:0], shape).write.parquet(path)
    while piece:
        frame = pd.DataFrame(piece, columns=["_source", "_block", "slot", "phase"])
        spark.createDataFrame(frame, shape).write.mode("append").parquet(path)
        piece = list(itertools.islice(rows, PIECE))
    return spark.read.schema(shape).parquet(path)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, chunk_rows: int) -> DataFrame:
    """``_id, _row, _source, _bytes, _start``: where each document begins in its source's stream."""
    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
                       F.greatest(F.octet_length(F.coalesce(text_col, F.lit(""))), F.lit(1)).cast("bigint").alias("_b"))
    rows = rows.groupBy("_id", "_row", "_source").agg(F.sum("_b").alias("_bytes"))
    rows = stored(rows, "sizes")
    chunks = max(1, -(-rows.count() // chunk_rows))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    sums = rows.groupBy("_source", "_chunk").agg(F.sum("_bytes").alias("_sum"))
    before = W.partitionBy("_source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_source", "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_source", "_chunk").orderBy("_row", "_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    rows = rows.join(sums, ["_source", "_chunk"])
    return stored(rows.select("_id", "_row", "_source", "_bytes", (F.col("_before") + F.col("_inside")).alias("_start")),
                  "placed")


def _by_pattern(rows: DataFrame, phases: list[tuple], patterns: list[tuple]) -> DataFrame:
    """``rows`` with the ``phase, slot`` that a :func:`schedule` gives their ``_source, _block``."""
    spark = rows.sparkSession
    phases = spark.createDataFrame(phases, "phase int, _source string, first_block bigint, end_block bigint, "
                                           "share bigint, period bigint, first_slot bigint")
    patterns = spark.createDataFrame(patterns, "phase int, _source string, turn bigint, at bigint")
    rows = rows.join(F.broadcast(phases), "_source").where("_block >= first_block AND _block < end_block")
    rows = rows.withColumn("turn", (F.col("_block") - F.col("first_block")) % F.col("share"))
    rows = rows.join(F.broadcast(patterns), ["phase", "_source", "turn"])
    slot = (F.col("first_slot") + F.floor((F.col("_block") - F.col("first_block")) / F.col("share")) * F.col("period")
            + F.col("at"))
    return rows.withColumn("slot", slot.cast("bigint"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", *, block_bytes: int = BLOCK_BYTES, period: int | None = None,
        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id_col, source_col, n_bytes, phase, slot, source_byte``, one row for each distinct (id, text, source).

    Sorted by ``slot, source_byte`` the documents are the mixture; a document lies where its first byte does. Every
    document is placed. ``weights`` (numbers or fractions, taken as they are) must name every source; the default is
    the square root of a source's bytes, which lifts small sources. A null source is the source "", a null or empty
    text one byte, rows that repeat id and text lie together. Other columns are ignored; an empty table gives an empty
    result. With ``period``, the weights are rounded to whole blocks of so many slots and one pattern of them repeats;
    sources are then at most ``period``."""
    spark = docs.sparkSession
    rows = _placed(docs, id_col, text_col, source_col, chunk_rows)
    totals = rows.groupBy("_source").agg(F.sum("_bytes").alias("n")).collect()
    size = {r["_source"]: r["n"] for r in totals}
    if weights is None:
        weights = {s: math.sqrt(n) for s, n in size.items()}
    if missing := sorted(set(size) - set(weights)):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    blocks = {s: -(-n // block_bytes) for s, n in size.items()}
    rows = rows.withColumn("_block", F.expr(f"_start div {int(block_bytes)}"))
    if period is None:
        rows = rows.join(_slots(spark, blocks, weights), ["_source", "_block"])
    else:
        rows = _by_pattern(rows, *schedule(blocks, weights, period))
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_bytes").alias("n_bytes"),
                       "phase", "slot", F.col("_start").alias("source_byte"), "_row")


def in_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """``docs`` in the order of the mixture, range-partitioned; its columns unchanged."""
    rows, at = docs.alias("docs"), mixed.alias("mixed")  # names of ``docs`` may be those of ``mixed``
    on: Column = ((row_key(f"docs.{id_col}", f"docs.{text_col}") == F.col("mixed._row"))
                  & F.col(f"docs.{id_col}").eqNullSafe(F.col(f"mixed.{id_col}"))
                  & (F.coalesce(F.col(f"docs.{source_col}").cast("string"), F.lit("")) == F.col(f"mixed.{source_col}")))
    order = [F.col("mixed.slot"), F.col("mixed.source_byte")]
    return rows.join(at, on).repartitionByRange(*order).sortWithinPartitions(*order).select("docs.*")
