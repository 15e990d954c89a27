"""Registered queries of the operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import bpe
from blocklens.llm.embedding_dedup import embedding_dedup
from blocklens.llm.exact_dedup import exact_dedup
from blocklens.llm.license_scan import license_scan
from blocklens.llm.line_dedup import line_dedup
from blocklens.llm.mixing import mix
from blocklens.llm.near_dedup import near_dedup
from blocklens.llm.periodic_runs import word_runs
from blocklens.llm.quality import quality
from blocklens.llm.substring_dedup import substring_dedup
from blocklens.llm.token_counts import token_counts
from blocklens.llm.toxicity import toxicity
from blocklens.llm.vector_codes import vector_codes

COUNT_MODEL = "piece_bpe_32k.model"
BPE_TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_read(spark, sf_dir, "documents"), tokenizer_file(COUNT_MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                      "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).drop("_row")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer_file(BPE_TOKENIZER))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), hash_all=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """In one of ten documents the words from a place on repeat with a period, both given by the id."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or doc_id is None or not n:
        return None
    i, a = np.arange(n), g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(_read(spark, sf_dir, "documents"), rewrite=repeated_words)
    long_first = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"]))
    best = F.array_min(long_first)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length = -best["n"]
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_read(spark, sf_dir, "embeddings"))


def all_queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
