"""Corpus pipeline: quality, exact dedup, near dedup, mixing, encoding, each stage on what the one before it kept."""

from __future__ import annotations

import itertools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import bpe, exact_dedup, mixing, near_dedup, quality
from blocklens.llm.common import row_key, shared_folder, stored
from blocklens.llm.queries import BPE_TOKENIZER, tokenizer_file

#: Smaller than the encoder's own blocks: its workers run beside what the earlier stages left in memory.
BLOCK_CHARS = 4_000_000
#: Rows of a batch that Spark hands to Python in any stage, for the same reason.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size; it holds when the stage's result is written, after the stage has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more)."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_model(docs, labels)
    own = {c: f"_quality_{uuid.uuid4().hex}" for c in ("score", "predicted")}  # no name of docs
    scored = quality.score(docs, model, score_col=own["score"], predicted_col=own["predicted"])
    return scored.where(F.col(own["predicted"]) == 1).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    marks = exact_dedup.exact_dedup(docs, keys=True).where("NOT kept")
    on = ((row_key("docs.doc_id", "docs.text") == F.col("gone._row"))
          & F.col("docs.doc_id").eqNullSafe(F.col("gone.doc_id")))
    return docs.alias("docs").join(marks.select("doc_id", "_row").distinct().alias("gone"), on, "left_anti")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with linked shingle sets: five words, similarity 0.8."""
    small_batches(spark)
    gone = near_dedup.near_dedup(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources take turns."""
    return mixing.in_order(docs, mixing.mix(docs))


def in_file_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, position`` of a table that Spark wrote, 0 being its first row. A scan takes files in any order,
    so rows are numbered by the task that wrote their file, the file's number in the task and the row in the file."""
    try:
        docs.metadataColumn("_metadata")
    except AnalysisException:  # not a stored table
        docs = stored(docs, "ordered")
    at = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", at["file_name"].alias("_file"), at["row_index"].alias("_index"))
    number = lambda form: F.regexp_extract("_file", form, 1).try_cast("bigint")
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).orderBy(
        number(r"^part-(\d+)"), number(r"-c(\d+)\."), "_file").collect()  # a row a file
    starts = list(zip((f["_file"] for f in files), itertools.accumulate((f["n"] for f in files), initial=0)))
    starts = docs.sparkSession.createDataFrame(starts, "_file string, _first bigint")
    rows = rows.join(F.broadcast(starts), "_file")
    return rows.select("doc_id", "text", (F.col("_first") + F.col("_index")).alias("position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded, position``: sorted by ``position`` the rows are in the order of ``docs``."""
    small_batches(spark)
    return bpe.encode(in_file_order(docs), tokenizer_file(BPE_TOKENIZER), block_chars=BLOCK_CHARS, place_col="position")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: Classifier scores, schedules and token ids can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again. Sorted by ``position`` the rows
    are the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
