"""From raw documents to packed token sequences.

Each stage works on all that its predecessor kept, is written as Parquet into the
shared folder and read again, so a lost executor never costs more than one
stage; what a stage read is removed when its successor stands. All stages but the
last return the columns of documents.

Defined cases: null and empty texts have no words: the classifier judges them, what passes
has no line to lose, is its own group, is taken at no cost and packs as its end
id. Very long texts are read whole. Repeated rows are judged alike; of rows with equal
doc_id and text one stays after the n-gram join. Null doc_ids come last in every
order. An empty table gives an empty result; columns besides those of documents are
carried whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenwright.llm import lines, mixing, packing, shingle_join, weak
from fenwright.llm.common import checkpoint_dir, release, remove, sweep
from fenwright.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (1): documents that it rejects go."""
    return weak.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (5): later similar lines go, and documents that thereby lose all words."""
    return lines.clean(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (10): of each group the document with the smallest doc_id stays."""
    return shingle_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (4): documents appear as often as their source's budget takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (9): pieces of power-of-two length with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokeniser are beyond SQL; tests/llm holds every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep()
        release(spark)
        if last:
            remove(spark, last)
        last = path
    return docs
