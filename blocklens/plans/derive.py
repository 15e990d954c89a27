"""Block tables from plain tables: deterministic layouts for text, forms and OCR words.

Every derivation is a projection of its source rows (one join for forms), dealt by document once before it
(:func:`spread`), so no block is shuffled and a document of any length stays in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PAGE = 22
WORDS_PER_ROW = 10
PARTITIONS_PER_SPLIT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, scan: DataFrame | None = None) -> DataFrame:
    """Source rows dealt by ``key`` before a projection makes many blocks of each, so every step that works by document
    finds its blocks in one task and moves a block only when it leaves its document. A document was one row before and
    stays in one task either way. The number of partitions grows with the splits of ``scan`` (default: ``df``), as a
    partition of blocks is many times its source rows.

    Joins by document and more keep that deal as aggregates do: Spark is told not to deal both sides anew by all keys."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    splits = (df if scan is None else scan).rdd.getNumPartitions()
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, PARTITIONS_PER_SPLIT * splits), key)


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block per non-blank text line, 22 rows a page, 30 pt apart."""
    lines = F.transform(F.split("text", "\n"),
                        lambda t, i: F.struct(F.trim(t).alias("t"), i.alias("ln")))
    d = documents.select("doc_id", F.posexplode(F.filter(lines, lambda s: s["t"] != "")).alias("block_seq", "s"))
    ln, t = F.col("s.ln"), F.col("s.t")
    y0 = (F.lit(60) + F.lit(30) * (ln % ROWS_PER_PAGE)).cast("double")
    return d.select(
        "doc_id", (F.floor(ln / ROWS_PER_PAGE) + 1).cast("int").alias("page"),
        F.col("block_seq").cast("bigint").alias("block_seq"), t.alias("text"),
        F.lit(72.0).alias("x0"), y0.alias("y0"),
        (F.lit(72) + F.lit(5) * F.length(t)).cast("double").alias("x1"), (y0 + F.lit(11.0)).alias("y1"),
        F.lit("native").alias("source"))


def word_blocks(documents: DataFrame, pitch: int = 30) -> DataFrame:
    """One block per word, ten words a row, 22 rows a page."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    rows = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS_PER_ROW).cast("int")),
        lambda r: F.slice("w", r * WORDS_PER_ROW + 1, WORDS_PER_ROW))
    d = (documents.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
         .select("doc_id", F.posexplode(rows).alias("row", "ws"))
         .select("doc_id", "row", "ws", F.posexplode("ws").alias("k", "text")))
    # Width of the words before: their joined text with one blank each, 5 pt a character.
    joined = F.length(F.array_join(F.slice("ws", F.lit(1), F.col("k")), " "))
    before = F.when(F.col("k") == 0, F.lit(72)).otherwise(joined * 5 + 77)
    y0 = (F.lit(60) + F.lit(pitch) * (F.col("row") % ROWS_PER_PAGE)).cast("double")
    return (d.withColumn("x0", before.cast("double")).select(
        "doc_id", (F.floor(F.col("row") / ROWS_PER_PAGE) + 1).cast("int").alias("page"),
        (F.col("row").cast("bigint") * WORDS_PER_ROW + F.col("k")).alias("block_seq"), "text",
        "x0", y0.alias("y0"), (F.col("x0") + F.length("text") * F.lit(5.0)).alias("x1"),
        (y0 + F.lit(11.0)).alias("y1"), F.lit("native").alias("source")))


def _form_rows() -> list[tuple[int, int, Column]]:
    order = F.col("o_orderkey").cast("string")
    return [
        (1, 120, F.concat(F.lit("Policy Number: POL-"), F.lpad(order, 8, "0"))),
        (1, 160, F.concat(F.lit("Member Name: "), F.col("c_name"))),
        (1, 200, F.lit("Order Date:")),
        (1, 230, F.date_format("o_orderdate", "yyyy-MM-dd")),
        (1, 280, F.lit("Market Segment")),
        (1, 310, F.concat(F.col("c_mktsegment"), F.lit(" segment"))),
        (2, 100, F.lit("Signature: __________")),
        (2, 160, F.lpad((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 8, "0")),
        (2, 680, F.concat(F.lit("Order Status: "), F.col("o_orderstatus"))),
    ]


def form_blocks(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A nine-block, two-page form per order; doc_id is the order key."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    blocks = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(float(y)).alias("y0"), t.alias("text"))
                       for p, y, t in _form_rows()])
    d = (spread(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey", scan=orders)
         .select(F.col("o_orderkey").alias("doc_id"), F.posexplode(blocks).alias("block_seq", "b")))
    return d.select("doc_id", "b.page", F.col("block_seq").cast("bigint").alias("block_seq"), "b.text",
                    F.lit(72.0).alias("x0"), "b.y0",
                    (F.length("b.text") * 5 + 72).cast("double").alias("x1"),
                    (F.col("b.y0") + F.lit(11.0)).alias("y1"), F.lit("native").alias("source"))


def ocr_words(words: DataFrame) -> DataFrame:
    """Two OCR engines over word blocks: engine 1 sees every word, engine 2 every third."""
    w = F.col("block_seq")
    conf = ((F.col("doc_id") * 7 + w * 13) % 101 - 1).cast("int")
    engines = F.when(w % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return words.select(
        "doc_id", "page", F.explode(engines).alias("engine"), F.lit(1).alias("ocr_pass"),
        F.lit(175).alias("dpi"), w.alias("word_seq"), "text", conf.alias("conf"),
        (F.col("x0") * 2).alias("left"), (F.col("y0") * 2).alias("top"),
        ((F.col("x1") - F.col("x0")) * 2).alias("width"), ((F.col("y1") - F.col("y0")) * 2).alias("height"),
        F.lit(0.5).alias("scale_x"), F.lit(0.5).alias("scale_y"))


def embedded_items(lines: DataFrame) -> DataFrame:
    """Text items of the embedded layer: one per line block, base line at its lower edge."""
    return lines.select("doc_id", "page", F.col("block_seq").alias("item_seq"), "text",
                        "x0", "y0", "x1", "y1", F.col("y1").alias("base_y"))
