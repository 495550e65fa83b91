"""Readers and writers: Parquet tables, JSON documents, operation logs, streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Rows as JSON documents (key, doc)."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*(columns or df.columns))).alias("doc"))


def export(df: DataFrame, path: str, key: str | None = None, files: int | None = None) -> None:
    """A snapshot as Parquet, clustered by key so that reads by key skip files."""
    out = df.repartitionByRange(files, key).sortWithinPartitions(key) if key and files else df
    out.write.mode("overwrite").parquet(path)


def tail(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as an unbounded log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
