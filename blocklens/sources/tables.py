"""Sources and sinks: folders of files, block tables, document catalog, deferred extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..plans import ordered
from ..plans.stage import materialise

SKIPPED_DETAIL = "skipped — not a .pdf"
HINT_PENDING = "Documents stored. Full text and field extraction will run next."
HINT_NO_TEXT = "No text was extracted (0 blocks). Check the OCR layer."


def list_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """File catalog of a folder: path, name, length, modificationTime. File content is not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "false").load(folder)
             .select("path", "length", "modificationTime"))
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def number_files(files: DataFrame, name: str = "name") -> DataFrame:
    """1-based position by lower-cased name, over ranges of whole names so no task sorts the list alone."""
    return ordered.range_positions(files.withColumn("_all", F.lit(0)), ["_all"], [F.lower(name), F.col(name)],
                                   "position", start=1).drop("_all")


def pick_files(files: DataFrame, *, count: int | None = None, pick: Sequence[int] | None = None,
               name: str = "name") -> DataFrame:
    """The first ``count`` files, or the files at the given 1-based positions."""
    numbered = number_files(files, name)
    if pick is not None:
        total = files.count()
        for p in pick:
            if not 1 <= p <= total:
                raise IndexError(f"index out of range: {p} (1..{total})")
        return numbered.filter(F.col("position").isin(list(pick)))
    return numbered.filter(F.col("position") <= max(1, count if count is not None else 3))


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, ingest_errors). Input: upload_index, filename and, where reading failed, detail."""
    if "detail" not in uploads.columns:
        uploads = uploads.withColumn("detail", F.lit(None).cast("string"))
    name = F.coalesce(F.col("filename"), F.lit("unknown.pdf"))
    is_pdf = F.lower(name).endswith(".pdf")
    u = uploads.withColumn("filename", name)
    bad = ~is_pdf | F.col("detail").isNotNull()
    errors = u.filter(bad).select(
        "upload_index", "filename",
        F.when(~is_pdf, F.lit(SKIPPED_DETAIL)).otherwise(F.col("detail")).alias("detail"))
    return u.filter(~bad).drop("detail"), errors


def require_some(accepted: DataFrame, errors: DataFrame) -> DataFrame:
    """A batch fails only when no file could be processed."""
    if accepted.isEmpty():
        first = errors.orderBy("upload_index").first()
        raise ValueError("no document could be processed. " + (first["detail"] if first else ""))
    return accepted


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Block rows; a ``bbox`` array is opened into x0..y1 and the reading order is assigned."""
    raw = spark.read.schema(schema.BLOCK_JSON).format(fmt).load(path)
    b = F.col("bbox")
    return to_blocks(raw.select("doc_id", "page", "text", *[b.getItem(i).alias(c) for i, c in
                                                            enumerate(("x0", "y0", "x1", "y1"))]))


def to_blocks(raw: DataFrame, source: str = "native") -> DataFrame:
    """Any rows with doc_id, page, text, x0..y1 as a block table in reading order."""
    if "source" not in raw.columns:
        raw = raw.withColumn("source", F.lit(source))
    tie = [F.col("ingest_seq")] if "ingest_seq" in raw.columns else []
    done = ordered.dense_positions(
        raw, ["doc_id"], {"_p": F.col("page"), "_b": ordered.band_of(F.col("y0"))},
        [F.col("page"), F.col("y0"), F.col("x0"), F.substring("text", 1, 96), *tie, F.col("text"),
         F.col("x1"), F.col("y1")], "block_seq")
    return done.select("doc_id", F.col("page").cast("int").alias("page"), "block_seq", "text",
                       "x0", "y0", "x1", "y1", "source")


def write_blocks(blocks: DataFrame, path: str, *, buckets: int = 64, mode: str = "overwrite") -> None:
    """Parquet in reading order. A bucket holds whole chunks of documents, so a huge document is
    spread over buckets as well."""
    chunk = ordered.chunk_of(F.col("block_seq"))
    (blocks.withColumn("doc_bucket", F.pmod(F.hash("doc_id", chunk), F.lit(buckets)))
     .repartition("doc_bucket").sortWithinPartitions("doc_id", "block_seq")
     .write.mode(mode).partitionBy("doc_bucket").parquet(path))


def blocks_json(blocks: DataFrame) -> DataFrame:
    """The exchange form {text, bbox, page}, one JSON string per block in reading order."""
    return blocks.select("doc_id", "block_seq", F.to_json(F.struct(
        "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "page")).alias("block"))


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))


def catalog(documents: DataFrame, fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Document list with field and block counts. Both counts combine before the shuffle."""
    return (documents.join(_counts(fields, "field_count"), "doc_id", "left")
            .join(_counts(blocks, "block_count"), "doc_id", "left")
            .na.fill(0, ["field_count", "block_count"]))


def session_labels(documents: DataFrame, max_len: int = 200) -> DataFrame:
    cols = ("transaction_type", "carrier", "vertical")
    return documents.withColumns({c: tx.trim_label(F.col(c), max_len) for c in cols})


def with_hint(cat: DataFrame) -> DataFrame:
    """Why a document shows no fields: not extracted yet, no text, or text without fields."""
    n = F.col("block_count").cast("string")
    return cat.withColumn("hint", F.when(F.col("field_count") > 0, F.lit(None).cast("string"))
                          .when(F.col("extraction_pending"), HINT_PENDING)
                          .when(F.col("block_count") == 0, HINT_NO_TEXT)
                          .otherwise(F.concat(F.lit("Found "), n,
                                              F.lit(" text blocks but no label:value fields."))))


def select_for_extraction(documents: DataFrame, ids: Sequence[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to extract, unknown ids). ``ids`` is a list or a table with doc_id; an empty list means every
    document."""
    spark = documents.sparkSession
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    elif not ids:
        return documents, spark.createDataFrame([], "doc_id bigint, detail string")
    else:
        wanted = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "doc_id bigint")
    unknown = wanted.join(documents.select("doc_id"), "doc_id", "left_anti").withColumn(
        "detail", F.lit("not in session"))
    return documents.join(wanted, "doc_id", "left_semi"), unknown


#: Partitions of a field store.
FIELD_BUCKETS = 64


def write_fields(fields: DataFrame, path: str, documents: DataFrame | None = None, *, buckets: int = FIELD_BUCKETS) -> None:
    """A field store: partitions by a hash of the document. With ``documents`` the rows of those documents are replaced
    (a document without fields loses its rows) and all others stay; only the partitions they fall into are written
    anew, by dynamic overwrite, the files of the others are not touched."""
    spark = fields.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    new = fields.withColumn("doc_bucket", bucket)
    if documents is not None:
        ids = documents.select("doc_id").distinct()
        hit = [r[0] for r in ids.select(bucket.alias("b")).distinct().collect()]  # a number a partition
        stored = spark.read.parquet(path)
        others = stored.filter(F.col("doc_bucket").isin(hit)).join(ids, "doc_id", "left_anti")
        gone = stored.filter(F.col("doc_bucket").isin(hit)).select("doc_bucket").distinct()
        new = materialise(new.unionByName(others.select(*new.columns)))  # read whole before its files are replaced
        # A partition left without rows would not be overwritten: it keeps a row that stands for none.
        empty = gone.join(new.select("doc_bucket").distinct(), "doc_bucket", "left_anti")
        blank = empty.select(*[F.col("doc_bucket") if f.name == "doc_bucket" else F.lit(None).cast(f.dataType).alias(f.name)
                               for f in new.schema.fields])
        new = new.unionByName(materialise(blank))
    dealt = F.pmod(F.xxhash64(*[c for c in new.columns if c != "doc_bucket"]), F.lit(8))  # one document isn't one task
    (new.repartition(F.col("doc_bucket"), dealt).write.mode("overwrite" if documents is not None else "errorifexists")
     .partitionBy("doc_bucket").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("doc_id IS NOT NULL").drop("doc_bucket")


def extract_deferred(documents: DataFrame, blocks: DataFrame, ids: Sequence[int] | DataFrame, path: str, detect
                     ) -> tuple[DataFrame, DataFrame]:
    """Second stage of a deferred extraction: the chosen documents' blocks through ``detect`` into the field store.
    Gives the documents with their flag cleared and the unknown ids."""
    chosen, unknown = select_for_extraction(documents, ids)
    chosen = materialise(chosen.select("doc_id").distinct())
    write_fields(detect(blocks.join(chosen, "doc_id", "left_semi")), path, chosen)
    return mark_extracted(documents, chosen), unknown


def mark_extracted(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """``extraction_pending`` cleared for the extracted documents."""
    done = extracted.select("doc_id").distinct().withColumn("_done", F.lit(True))
    return (documents.join(done, "doc_id", "left")
            .withColumn("extraction_pending", F.when(F.col("_done"), F.lit(False))
                        .otherwise(F.col("extraction_pending"))).drop("_done"))


def latest(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` log rows (a top-n per partition, then of those)."""
    return log.orderBy(F.col("ts").desc(), F.col("action"), F.col("doc_id"), F.col("detail")).limit(n)


def upload_order(documents: DataFrame) -> DataFrame:
    """``upload_index`` as 0-based position by doc_id for tables that lack one."""
    return ordered.range_positions(documents.withColumn("_all", F.lit(0)), ["_all"], [F.col("doc_id")],
                                   "upload_index").drop("_all")
