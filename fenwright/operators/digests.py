"""Mergeable states with their sizes: quantile digests, membership filters, frequency tables, heavy hitters.

A digest of a key is rows (key, mean, weight, low, high): centroids that are narrow at the
ends and wide in the middle. States of disjoint data are merged by union and `compress`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketches import bloom_exists, bloom_size, fingerprints

SIZE = 100  # of a digest; a key keeps about so many centroids


def _cluster(rows: DataFrame, size: int) -> DataFrame:
    """Centroids of rows (key, mean, weight, low, high): runs of the order between steps of the scale asin(2q - 1)."""
    w = Window.partitionBy("key")
    upto = F.sum("weight").over(w.orderBy("mean", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = (upto - F.col("weight") / 2) / F.sum("weight").over(w)
    step = F.floor(size * (F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * q - 1))) / math.pi + 0.5))
    placed = rows.select("*", step.alias("_step"))
    return placed.groupBy("key", "_step").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")).drop("_step")


def digest(df: DataFrame, key: str, value: str, size: int = SIZE, salts: int = 64) -> DataFrame:
    """A digest of each key: values meet in `salts` parts a key first, so a hot key is no one task's."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(key).alias("key"), v.alias("mean")).groupBy("key", "mean").agg(F.count("*").cast("double").alias("weight"))
    part = rows.select(F.struct("key", F.pmod(F.xxhash64("mean"), F.lit(salts)).alias("s")).alias("key"), "mean", "weight", F.col("mean").alias("low"), F.col("mean").alias("high"))
    parts = _cluster(part, 4 * size)
    return _cluster(parts.select(F.col("key.key").alias("key"), "mean", "weight", "low", "high"), size)


def merge(*digests: DataFrame, into=None, size: int = SIZE) -> DataFrame:
    """One digest from several, of each key, or of all keys under the name `into`."""
    out = digests[0]
    for d in digests[1:]:
        out = out.unionByName(d)
    return _cluster(out if into is None else out.withColumn("key", F.lit(into)), size)


def _spans(digests: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("mean", "low")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return digests.select("*", F.coalesce(upto, F.lit(0.0)).alias("start"), F.sum("weight").over(Window.partitionBy("key")).alias("total"))


def _inside(c: Column) -> Column:
    """A value at a share of a centroid's weight, between its ends."""
    return F.col("low") + (F.col("high") - F.col("low")) * c


def at_rank(digests: DataFrame, ranks: list[float], reverse: bool = False) -> DataFrame:
    """(key, rank, value): the value with so many values below it (above it if reverse); -inf before the first, inf past the last as ranks run."""
    s = _spans(digests)
    asked = s.select("key", "mean", "low", "high", "weight", "start", "total", F.explode(F.array(*[F.lit(float(r)) for r in ranks])).alias("rank"))
    place = (F.col("total") - 1 - F.col("rank")) if reverse else F.col("rank")
    at = asked.select("*", place.alias("place"))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("weight"))
    share = F.when(F.col("weight") > 1, (F.col("place") - F.col("start")) / (F.col("weight") - 1)).otherwise(F.lit(0.0))
    found = F.max(F.when(inside, _inside(F.least(F.lit(1.0), share))))
    out = at.groupBy("key", "rank").agg(found.alias("value"), F.max("place").alias("place"), F.max("total").alias("total"))
    return out.select("key", "rank", F.when(F.col("place") >= F.col("total"), F.lit(float("inf"))).when(F.col("place") < 0, F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"))


def quantile(digests: DataFrame, shares: list[float]) -> DataFrame:
    """(key, share, value) by linear place between a centroid's ends."""
    s = _spans(digests)
    asked = s.select("*", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share"))
    place = F.col("share") * (F.col("total") - 1)
    inside = (place >= F.col("start") - 1e-9) & (place < F.col("start") + F.col("weight"))
    part = F.when(F.col("weight") > 1, (place - F.col("start")) / (F.col("weight") - 1)).otherwise(F.lit(0.0))
    return asked.groupBy("key", "share").agg(F.max(F.when(inside, _inside(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))))).alias("value"))


def digest_info(digests: DataFrame, size: int = SIZE) -> DataFrame:
    return digests.groupBy("key").agg(F.lit(size).alias("compression"), F.count("*").alias("centroids"), F.sum("weight").cast("bigint").alias("observations"), F.min("low").alias("min"), F.max("high").alias("max"))


def reset(digests: DataFrame, key) -> DataFrame:
    return digests.where(F.col("key") != F.lit(key))


def filter_info(state: DataFrame, capacity: int, error: float = 0.01) -> DataFrame:
    """Capacity, bits, hashes and the estimated number of distinct items of a membership filter."""
    bits, hashes = bloom_size(capacity, error)
    on = F.sum(F.bitmap_count("bits"))
    n = -F.lit(bits / hashes) * F.log(1 - F.least(on, F.lit(bits - 1)) / bits)
    return state.agg(F.lit(capacity).alias("capacity"), F.lit(bits).alias("bits"), F.lit(hashes).alias("hashes"), F.round(F.coalesce(n, F.lit(0.0))).cast("bigint").alias("items"))


def new_items(state: DataFrame, df: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """Distinct items that an addition changes the filter by: those it does not hold yet."""
    return bloom_exists(state, df.select(item).distinct(), item, capacity, error).where("not maybe").drop("maybe")


def fingerprint_add(state: DataFrame, df: DataFrame, item: str, bits: int = 16, only_new: bool = False) -> DataFrame:
    """A counting filter with the items of df added; only_new: once, and only those that it does not hold."""
    delta = fingerprints(df, item, bits)
    if only_new:
        delta = delta.select("f", F.lit(1).cast("bigint").alias("n")).join(state.select("f"), "f", "left_anti")
    return state.unionByName(delta).groupBy("f").agg(F.sum("n").alias("n"))


def fingerprint_info(state: DataFrame, bits: int = 16) -> DataFrame:
    return state.agg(F.lit(2 * bits).alias("bits"), F.count("*").alias("fingerprints"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("items"))


def frequency_size(error: float, probability: float) -> tuple[int, int]:
    """Width and depth of a frequency table whose counts exceed the true ones by a share `error` of all, but for `probability`."""
    return math.ceil(2 / error), math.ceil(math.log(probability) / math.log(0.5))


def frequency_info(state: DataFrame, width: int, depth: int) -> DataFrame:
    return state.agg(F.lit(width).alias("width"), F.lit(depth).alias("depth"), F.coalesce(F.sum(F.when(F.col("row") == 0, F.col("n"))), F.lit(0)).cast("bigint").alias("count"))


def in_top(top: DataFrame, wanted: DataFrame, item: str) -> DataFrame:
    """wanted with `listed`: whether an item is among the heavy hitters."""
    return wanted.join(top.select(item, F.lit(True).alias("listed")), item, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
