"""Suffix order of many symbol sequences by the difference-cover method, as DataFrame steps.

Positions 1 and 2 modulo 3 are the sample. Their triples of symbols are sorted and named by rank; unless all names
differ, the names, laid out by residue, are shorter sequences that are ordered in the same way. The remaining suffixes
are merged in by counting: a suffix at residue 0 compares with one at residue 1 by its symbol and the sample rank
behind it, and with one at residue 2 by two symbols and the rank behind those, so each suffix's place is a sum of two
numbers of smaller suffixes. Every order is a range-partitioned sort with one total a partition carried forward; equal
keys are summed before they are sorted, so no key fills a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import stored


def _running(sums: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names if c not in sums}
            columns["_task"] = np.full(batch.num_rows, task, np.int64)
            for c in sums:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values) + before[c]
                columns[c], columns[f"_n_{c}"] = upto - values, values
                before[c] = int(upto[-1]) if len(upto) else before[c]
            yield pa.RecordBatch.from_pydict(columns)

    return run


def smaller(groups: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``groups`` (one row a key, keys and sums of type bigint) with each sum replaced by that over smaller keys."""
    schema = ", ".join([f"`{k}` bigint" for k in keys] + ["`_task` bigint"]
                       + [f"`{c}` bigint, `_n_{c}` bigint" for c in sums])
    rows = groups.select(*keys, *(F.col(c).cast("bigint").alias(c) for c in sums))
    rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_running(sums), schema), "order")
    totals = rows.groupBy("_task").agg(*(F.sum(f"_n_{c}").alias(c) for c in sums)).collect()  # a row a partition
    seen, before = dict.fromkeys(sums, 0), []
    for total in sorted(totals, key=lambda r: r["_task"]):
        before.append((total["_task"], *(seen[c] for c in sums)))
        seen = {c: seen[c] + total[c] for c in sums}
    before = rows.sparkSession.createDataFrame(before, ", ".join(["_task bigint"] + [f"`_b_{c}` bigint" for c in sums]))
    return rows.join(F.broadcast(before), "_task").select(*keys, *((F.col(c) + F.col(f"_b_{c}")).alias(c) for c in sums))


def suffix_ranks(symbols: DataFrame, depth: int) -> DataFrame:
    """``seq, pos, rank`` of ``symbols`` (seq bigint, pos bigint from 0 on without gaps, name bigint > 0).

    ``rank`` is the number of suffixes that are smaller; equal ones share it. Suffixes that agree in their first
    ``depth`` symbols may come in any order, those that differ there are in order; so suffixes with a common prefix of
    up to ``depth`` symbols are neighbours. A sequence's end is smaller than any symbol. An empty table has no ranks."""
    along = W.partitionBy("seq").orderBy("pos")
    rows = symbols.select("seq", "pos", "name", F.lead("name", 1, 0).over(along).alias("n1"),
                          F.lead("name", 2, 0).over(along).alias("n2"), (F.col("pos") % 3).alias("res"))
    rows = stored(rows, "symbols")
    triple = ["name", "n1", "n2"]
    sample = rows.where("res <> 0")
    names = sample.groupBy(*triple).agg(F.count(F.lit(1)).alias("c")).withColumn("d", F.lit(1))
    ordered = smaller(names, triple, ["c", "d"])
    named = sample.join(ordered, triple)
    if depth > 3 and not names.where("c > 1").isEmpty():
        child = named.select((F.col("seq") * 2 + F.col("res") - 1).alias("seq"),
                             F.floor(F.col("pos") / 3).alias("pos"), (F.col("d") + 1).alias("name"))
        ranks = suffix_ranks(child, -(-depth // 3)).select(
            F.shiftright("seq", 1).alias("seq"), (F.col("pos") * 3 + F.col("seq").bitwiseAND(1) + 1).alias("pos"), "rank")
    else:
        ranks = named.select("seq", "pos", F.col("c").alias("rank"))
    full = rows.join(ranks, ["seq", "pos"], "left")
    behind = lambda k: F.coalesce(F.lead("rank", k).over(along) + 1, F.lit(0))
    full = stored(full.select("seq", "pos", "name", "n1", "res", "rank", behind(1).alias("r1"), behind(2).alias("r2")),
                  "ranked")

    def counted(keys, other):
        groups = full.where(F.col("res").isin(0, other)).groupBy(*keys).agg(
            F.count_if(F.col("res") == 0).alias("first"), F.count_if(F.col("res") == other).alias("other"))
        return smaller(groups, keys, ["first", "other"])

    one, two = counted(["name", "r1"], 1), counted(["name", "n1", "r2"], 2)
    zero = (full.where("res = 0").join(one, ["name", "r1"])
            .join(two.select("name", "n1", "r2", F.col("other").alias("second")), ["name", "n1", "r2"])
            .select("seq", "pos", (F.col("first") + F.col("other") + F.col("second")).alias("rank")))
    rest = [full.where(f"res = {k}").join(table, keys).select("seq", "pos", (F.col("rank") + F.col("first")).alias("rank"))
            for k, keys, table in ((1, ["name", "r1"], one), (2, ["name", "n1", "r2"], two))]
    return stored(zero.unionByName(rest[0]).unionByName(rest[1]), "ranks")
