"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, which the session names in spark.checkpoint.dir or setCheckpointDir."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder; later plans start there and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """Tables written to the shared folder, to be read by column and removed when used."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        remove(self.spark, self.folder)


_OPEN: list[Stored] = []


def sweep() -> None:
    """Removes all stored tables; for callers that have written what they read of them."""
    while _OPEN:
        try:
            _OPEN.pop().close()
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(sweep)


_IDS = itertools.count(1 << 32)


def each(array: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """F.transform of an array of type `kind` without nulls, compiled with its row.

    Spark walks through the function of F.transform node by node for each element; the loop that its
    encoders use does the same as generated code. Where that loop cannot be had, F.transform stays.
    """
    jvm = SparkSession.active().sparkContext._jvm
    try:
        loop, classic = jvm.org.apache.spark.sql.catalyst.expressions.objects, jvm.org.apache.spark.sql.classic.ExpressionUtils
        x = loop.LambdaVariable("x", jvm.org.apache.spark.sql.types.DataType.fromDDL(kind), False, next(_IDS))
        body = classic.expression(f(Column(classic.column(x)))._jc)
        return Column(classic.column(loop.MapObjects(x, body, classic.expression(array._jc), jvm.scala.Option.empty())))
    except (TypeError, Py4JError):  # another Spark
        return F.transform(array, f)


def row_key(docs: DataFrame) -> Column:
    """Two hashes over all columns and over which of them are null: rows with equal keys are the same row.

    Maps, which have no order, count by their sorted entries.
    """
    values = []
    for c, kind in docs.dtypes:
        v = F.col(f"`{c}`")
        values += [F.array_sort(F.map_entries(v)) if kind.startswith("map<") else v, v.isNull()]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def bitmap_of(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for each value of the long column `key` modulo 2**bits: at most 2**bits / 8 bytes, for any input."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    rows = (
        df.select(slot.alias("s"))
        .groupBy(F.expr("bitmap_bucket_number(s)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m"))
        .collect()
    )
    # bucket b > 0 holds values 32768 * (b - 1) + 1 .. 32768 * b; bucket 0 holds 0 only as bit 0 of its own block
    out = np.zeros((1 << bits) // 8 + 8192, np.uint8)
    flags = np.unpackbits(out, bitorder="little")
    for r in rows:
        m = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        on = np.flatnonzero(m)
        base = 32768 * (r["b"] - 1) + 1 if r["b"] > 0 else 0
        flags[base + on] = 1
    return np.packbits(flags, bitorder="little")


def bit_test(df: DataFrame, key: str, most: int = 24):
    """A test of long columns that holds for all values of df's column `key`, and for few others while df has few rows.

    Its table of at most 2**most bits is read as a subquery of one row, so plans stay short.
    It only spares work: what it lets pass must still be joined.
    """
    rows = df.select(F.col(key).alias("key"))
    bits = min(most, max(12, (16 * rows.count()).bit_length()))
    words = bitmap_of(rows, "key", bits)[: (1 << bits) // 8].view("<i8")
    table = df.sparkSession.createDataFrame([(words.tolist(),)], "bits array<bigint>").scalar()

    def test(key: Column) -> Column:
        word = F.get(table, F.shiftrightunsigned(key, 6).bitwiseAND((1 << bits - 6) - 1).cast("int"))
        return F.getbit(word, key.bitwiseAND(63).cast("int")) == 1

    return test


def has_bit(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    slot = key.astype(np.int64) & np.int64((1 << bits) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Values of a text column as bytes; null gives b''."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def hashes(words: list[bytes], cache: dict[bytes, int], limit: int = 300_000) -> np.ndarray:
    """64-bit hash of each word. cache is emptied when it is full, so memory stays bounded."""
    import xxhash

    if len(cache) > limit:
        cache.clear()
    h = xxhash.xxh3_64_intdigest
    get = cache.get
    out = []
    for w in words:
        x = get(w)
        if x is None:
            x = cache[w] = h(w)
        out.append(x)
    return np.array(out, np.uint64)


def release(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files that no plan refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
