"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert, itq, lines, mincut, mixing, oracles, packing, ppm, rules, shingle_join, weak

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(_read(spark, sf_dir, "documents"))


def op2_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.main_text(_read(spark, sf_dir, "pages"))


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", "_dedup.n_lines", "_dedup.n_removed", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    )


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near(_read(spark, sf_dir, "embeddings"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {q.__name__: q for q in (op1_weak, op2_mincut, op3_hilbert, op4_mixing, op5_lines, op6_itq, op7_ppm, op8_rules, op9_packing, op10_shingles)}

ORACLE_SQL = oracles.ORACLE_SQL
