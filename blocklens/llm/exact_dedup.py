"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows whose normalised length is unique leave at once; of the rest those with a unique prefix hash. Only what
survives both has its whole text hashed, guided by a table of at most ``BUCKETS`` buckets that hold a surviving
(length, prefix hash) pair: the one thing broadcast, and bounded whatever the size of the data. A row in such a
bucket by chance is hashed too and found unique. No text is ever shuffled.

Groups are counted by pre-aggregation; the join that hands a group's result to its rows has one row a group on one
side, so that a group with a third of all rows can be split. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import row_key, stored, utf8_text

PREFIX_CHARS = 256
BUCKETS = 1 << 16


def normalised(text_col: str) -> Column:
    """Null is empty; each run of blanks becomes one space."""
    return F.regexp_replace(utf8_text(text_col), r"[\x20\x09-\x0D]+", " ")


def _keys(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``_id, _row, _body, _n, _p``: nothing of the caller's other columns, so none can clash."""
    body = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"),
                       normalised(text_col).alias("_body"))
    return body.select("_id", "_row", "_body", F.octet_length("_body").alias("_n"),
                       F.xxhash64(F.substring("_body", 1, prefix_chars)).alias("_p"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("_n", "_p"), F.lit(buckets))


def surviving_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                      prefix_chars: int = PREFIX_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """Buckets (at most ``buckets`` rows, ``_bucket``) that hold a (length, prefix hash) pair of two rows or more."""
    short = stored(_keys(docs, id_col, text_col, prefix_chars).select("_n", "_p"), "lengths")
    pairs = short.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_c"))
    lengths = pairs.groupBy("_n").agg(F.sum("_c").alias("_rows")).where("_rows > 1").select("_n")
    pairs = pairs.join(lengths, "_n", "left_semi").where("_c > 1")
    return stored(pairs.select(_bucket(buckets).alias("_bucket")).distinct(), "buckets")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                prefix_chars: int = PREFIX_CHARS, buckets: int = BUCKETS, hash_all: bool = False,
                keys: bool = False) -> DataFrame:
    """``id_col, keep_id, group_size, kept`` (``text_sha256`` with ``hash_all``, ``_row`` with ``keys``), one row for each row of ``docs``.

    Null and empty texts are equal. The smallest id of a group stays; rows that repeat that id in the group all stay
    (an id names a document). A null id never wins over another; a group of null ids alone keeps its rows, with a
    null ``keep_id``. Other columns are ignored, an empty table gives an empty result."""
    flags = surviving_buckets(docs, id_col, text_col, prefix_chars=prefix_chars, buckets=buckets)
    rows = (_keys(docs, id_col, text_col, prefix_chars).withColumn("_bucket", _bucket(buckets))
            .join(F.broadcast(flags.withColumn("_open", F.lit(True))), "_bucket", "left"))
    full = F.sha2("_body", 256)
    rows = rows.select("_id", "_row", "_n", "_p", "_open",
                       (full if hash_all else F.when(F.col("_open"), full)).alias("_sha"))
    rows = stored(rows, "hashes")
    groups = (rows.where("_open").groupBy("_n", "_p", "_sha")
              .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1"))
    out = rows.join(groups, ["_n", "_p", "_sha"], "left")
    single = F.col("_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("_keep"))
    columns = [F.col("_id").alias(id_col), keep.alias("keep_id"),
               F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
               F.col("_id").eqNullSafe(keep).alias("kept")]
    return out.select(*columns, *([F.col("_sha").alias("text_sha256")] if hash_all else []),
                      *(["_row"] if keys else []))
