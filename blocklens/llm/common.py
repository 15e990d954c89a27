"""Shared helpers of the operators: tables in the shared folder, row keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to delete a query's shuffle files when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without the setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="blocklens-")
    return _own[app]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")  # the table replaces them
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Memory a worker has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for the batches of a task. Workers are reused, so what it freed is given back when it ends."""
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def utf8_text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as ``node, root``, the root being the smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks twice and relabels the edges, so the
    graph shrinks; only distributed joins, ended when no edge is left. Loops and repeated edges are allowed; nodes
    without an edge to another node get no row."""
    spark = edges.sparkSession
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hook = stored(hook, "hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up").select("node", F.col("top").alias("up"))
        hook = stored(hook, "hooks")
        if roots is None:
            roots = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "up")
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")),
                           "roots")
        for side in ("a", "b"):
            step = hook.select(F.col("node").alias(side), F.col("up").alias("_up"))
            left = left.join(step, side).drop(side).withColumnRenamed("_up", side)
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .distinct(), "edges")
    if roots is None:
        kind = edges.schema["a"].dataType
        roots = spark.range(0).select(F.col("id").cast(kind).alias("node"), F.col("id").cast(kind).alias("root"))
    return roots
