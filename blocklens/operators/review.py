"""Review state: an append-only log of actions, and the queue derived from fields and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from .fields import SEE_PAGE

COMPLETE = "COMPLETE"


def append_actions(actions: DataFrame, path: str) -> None:
    """Append rows (action, doc_id, detail) to the log with the current time."""
    actions.select(F.current_timestamp().alias("ts"), "action", "doc_id", "detail").write.mode(
        "append").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(schema.REVIEW_LOG).parquet(path)


def completions(log: DataFrame) -> DataFrame:
    """Distinct (doc_id, field_id) that were completed. The detail of such a row is the field id."""
    return (log.filter(F.col("action") == COMPLETE)
            .select("doc_id", F.col("detail").alias("field_id")).distinct())


def apply_completions(fields: DataFrame, completed: DataFrame) -> DataFrame:
    """The first row of a completed field_id becomes ``completed``; the same id further on stays."""
    first = (fields.join(completed.distinct(), ["doc_id", "field_id"], "left_semi")
             .groupBy("doc_id", "field_id").agg(F.min("field_seq").alias("field_seq"))
             .withColumn("_done", F.lit(True)))
    keys = ["doc_id", "field_id", "field_seq"]
    return fields.join(first, keys, "left").withColumn(
        "status", F.when(F.col("_done"), F.lit("completed")).otherwise(F.col("status"))).drop("_done").select(
        *fields.columns)


def unknown_completions(fields: DataFrame, completed: DataFrame) -> DataFrame:
    return completed.distinct().join(fields.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti")


def is_open(status: Column, value: Column) -> Column:
    """Pending, with a value that can be shown."""
    v = tx.strip(value)
    return (status == "pending") & value.isNotNull() & (v != "") & (v != SEE_PAGE)


def _rank() -> Column:
    return F.struct(
        F.coalesce(F.col("priority").try_cast("int"), F.lit(99)).alias("p"),
        (-F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))).alias("c"),
        F.coalesce(F.col("section"), F.lit("")).alias("s"), F.col("field_seq").alias("q"))


def next_fields(fields: DataFrame) -> DataFrame:
    """The next field of every document: an aggregate that keeps one row per document and task."""
    rest = [c for c in fields.columns if c != "doc_id"]
    return (fields.filter(is_open(F.col("status"), F.col("value"))).groupBy("doc_id")
            .agg(F.min_by(F.struct(*rest), _rank()).alias("f")).select("doc_id", "f.*"))


def review_queue(fields: DataFrame) -> DataFrame:
    """All open fields in the order they will be offered."""
    return fields.filter(is_open(F.col("status"), F.col("value"))).orderBy("doc_id", _rank())


def progress(fields: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return fields.groupBy("doc_id").agg(
        is_("pending").alias("pending"), is_("completed").alias("completed"),
        F.count_if(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) < 0.7).alias("needs_review"))
