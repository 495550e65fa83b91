"""Approximate aggregates: distinct counts, membership filters, frequencies, heavy hitters, quantiles.

States are aggregates of fixed size that merge, so they pre-aggregate before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_state(df: DataFrame, keys: list[str], item: str, lg_k: int = 14) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, lg_k).alias("state"))


def distinct_count(states: DataFrame) -> DataFrame:
    """Estimated distinct items over all given states."""
    return states.agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("n"))


def _slots(item: Column, hashes: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(item, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a filter."""
    import math

    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def bloom(df: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """A filter as rows (block, bits) of 32768 bits: it grows in rows, so no task or message holds all of it."""
    bits, hashes = bloom_size(capacity, error)
    s = df.select(F.explode(_slots(F.col(item), hashes, bits)).alias("s"))
    return s.groupBy(F.expr("bitmap_bucket_number(s)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))


def bloom_exists(state: DataFrame, df: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """df with `maybe`: false means certainly absent."""
    bits, hashes = bloom_size(capacity, error)
    items = df.select(item).distinct()
    probes = items.select(item, F.explode(_slots(F.col(item), hashes, bits)).alias("s")).select(item, F.expr("bitmap_bucket_number(s)").alias("block"), F.expr("bitmap_bit_position(s)").alias("at"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    hit = F.coalesce(F.call_function("shiftright", byte, F.pmod("at", F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    found = probes.join(state, "block", "left").groupBy(item).agg(F.bool_and(hit).alias("maybe"))
    return df.join(found, item, "left")


def fingerprints(df: DataFrame, item: str, bits: int = 16) -> DataFrame:
    """A filter that counts and deletes: fingerprints by bucket with multiplicities."""
    return df.select(_fingerprint(F.col(item), bits).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


def _fingerprint(item: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(item), 64 - 2 * bits)


def fingerprint_count(state: DataFrame, df: DataFrame, item: str, bits: int = 16) -> DataFrame:
    """df with `n`, at least the true multiplicity."""
    return df.withColumn("f", _fingerprint(F.col(item), bits)).join(state, "f", "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("f")


def fingerprint_delete(state: DataFrame, df: DataFrame, item: str, bits: int = 16) -> DataFrame:
    gone = df.select(_fingerprint(F.col(item), bits).alias("f")).groupBy("f").agg(F.count("*").alias("_g"))
    return state.join(gone, "f", "left").select("f", (F.col("n") - F.coalesce("_g", F.lit(0))).alias("n")).where("n > 0")


def frequencies(df: DataFrame, item: str, width: int = 2000, depth: int = 5, amount: str | None = None) -> DataFrame:
    """Count-min cells (row, cell, n): at most width * depth rows, pre-aggregated."""
    n = F.sum(amount) if amount else F.count("*")
    cells = df.select(F.posexplode(_slots(F.col(item), depth, width)).alias("row", "cell"), *([amount] if amount else []))
    return cells.groupBy("row", "cell").agg(n.cast("bigint").alias("n"))


def frequency(state: DataFrame, df: DataFrame, item: str, width: int = 2000, depth: int = 5) -> DataFrame:
    """Distinct items of df with estimated counts, never below the true ones."""
    probes = df.select(item).distinct().select(item, F.posexplode(_slots(F.col(item), depth, width)).alias("row", "cell"))
    return probes.join(state, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def merge_frequencies(states: list[tuple[DataFrame, int]]) -> DataFrame:
    """Weighted sum of cells."""
    out = None
    for s, w in states:
        s = s.withColumn("n", F.col("n") * w)
        out = s if out is None else out.unionByName(s)
    return out.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def top_k(df: DataFrame, item: str, k: int = 10, amount: str | None = None) -> DataFrame:
    """The k most frequent items exactly: counts pre-aggregate, and each task keeps k."""
    return df.groupBy(item).agg((F.sum(amount) if amount else F.count("*")).alias("n")).orderBy(F.desc("n"), item).limit(k)


def approx_top_k(df: DataFrame, item: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """The k most frequent items by a summary of fixed size."""
    return df.agg(F.expr(f"approx_top_k({item}, {k}, {tracked})").alias("t")).select(F.explode("t").alias("x")).select(F.col("x.item").alias(item), F.col("x.count").alias("n"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile_approx(value, at, accuracy).alias("q"))


def ranks(df: DataFrame, keys: list[str], value: str, at: float) -> DataFrame:
    """cdf (share <= at), rank (values below), revrank (values above), min and max, exactly and in one pass."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg((v <= at).cast("double")).alias("cdf"), F.sum((v < at).cast("bigint")).alias("rank"), F.sum((v > at).cast("bigint")).alias("revrank"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def trimmed_mean(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Mean of the values between two quantiles."""
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    return df.join(cuts, keys).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys).agg(F.avg(value).alias("mean"))
