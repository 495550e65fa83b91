"""Time series, tables of (key, ts, value): duplicates, retention, label index, downsampling rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import ranges, running


def resolve(samples: DataFrame, policy: str = "LAST", order: str = "seq") -> DataFrame:
    """One value per (key, ts): FIRST, LAST, MIN, MAX or SUM of the samples; BLOCK is an error on a duplicate."""
    if policy == "BLOCK":
        once = F.when(F.count("*") == 1, F.min("value")).otherwise(F.raise_error(F.lit("duplicate timestamp")).cast("double"))
        return samples.groupBy("key", "ts").agg(once.alias("value"))
    pick = {"FIRST": F.min_by("value", order), "LAST": F.max_by("value", order), "MIN": F.min("value"), "MAX": F.max("value"), "SUM": F.sum("value")}[policy]
    return samples.groupBy("key", "ts").agg(pick.alias("value"))


def retain(samples: DataFrame, retention: int) -> DataFrame:
    """Samples not older than the key's latest minus retention (0: all)."""
    if not retention:
        return samples
    last = samples.groupBy("key").agg(F.max("ts").alias("_last"))
    return samples.join(last, "key").where(F.col("ts") >= F.col("_last") - retention).drop("_last")


def between(samples: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    out = samples
    if start is not None:
        out = out.where(F.col("ts") >= start)
    return out if stop is None else out.where(F.col("ts") <= stop)


def remove(samples: DataFrame, start: int, stop: int) -> DataFrame:
    return samples.where(~F.col("ts").between(start, stop))


def last(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def with_labels(meta: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows of meta (key, labels map) whose labels equal all given ones."""
    out = meta
    for k, v in labels.items():
        out = out.where(F.try_element_at("labels", F.lit(k)) == v)
    return out


def of_labels(samples: DataFrame, meta: DataFrame, labels: dict[str, str]) -> DataFrame:
    return samples.join(with_labels(meta, labels).select("key"), "key", "left_semi")


def increment(log: DataFrame) -> DataFrame:
    """Running sums of (key, ts, delta, seq): the last value of each ts stands."""
    run = running(log, ["key"], [F.col("ts"), F.col("seq")], F.col("delta"), "value")
    return run.groupBy("key", "ts").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def bucket(ts: Column | str, width: int, alignment: int = 0) -> Column:
    """Start of the tumbling bucket, by floor division also before the alignment."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return t - F.pmod(t - alignment, F.lit(width))


AGGREGATES = {
    "avg": lambda: F.avg("value"),
    "first": lambda: F.min_by("value", "ts"),
    "last": lambda: F.max_by("value", "ts"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "sum": lambda: F.sum("value"),
    "range": lambda: F.max("value") - F.min("value"),
    "count": lambda: F.count("value").cast("double"),
    "std.p": lambda: F.stddev_pop("value"),
    "std.s": lambda: F.coalesce(F.stddev_samp("value"), F.lit(0.0)),
    "var.p": lambda: F.var_pop("value"),
    "var.s": lambda: F.coalesce(F.var_samp("value"), F.lit(0.0)),
}


def downsample(samples: DataFrame, aggregate: str, width: int, alignment: int = 0, keep_open: bool = False) -> DataFrame:
    """(key, ts, value) per bucket; the bucket of a key's latest sample is still open and is left out."""
    b = bucket("ts", width, alignment)
    out = samples.groupBy("key", b.alias("bucket")).agg(AGGREGATES[aggregate]().alias("value"))
    if not keep_open:
        open_ = samples.groupBy("key").agg(bucket(F.max("ts"), width, alignment).alias("_open"))
        out = out.join(open_, "key").where(F.col("bucket") < F.col("_open")).drop("_open")
    return out.withColumnRenamed("bucket", "ts")


def alter(series: DataFrame, key, retention: int | None = None, labels: dict[str, str] | None = None, duplicates: str | None = None) -> DataFrame:
    """The series table (key, retention, labels, duplicates) with the given settings of one key; what is not given stays."""
    here = F.col("key") == F.lit(key)
    new = {
        "retention": None if retention is None else F.lit(retention),
        "labels": None if labels is None else F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]),
        "duplicates": None if duplicates is None else F.lit(duplicates),
    }
    return series.select(*[F.when(here, new[c].cast(series.schema[c].dataType)).otherwise(F.col(c)).alias(c) if new.get(c) is not None else F.col(c) for c in series.columns])


def delete_rule(rules: DataFrame, source, target) -> DataFrame:
    """The rules (source, target, aggregate, width, alignment) without one."""
    return rules.where(~((F.col("source") == F.lit(source)) & (F.col("target") == F.lit(target))))


def closed_once(samples: DataFrame, aggregate: str, width: int, alignment: int = 0, order: str = "seq") -> DataFrame:
    """Downsampling as a rule that fires on arrival: a bucket is written when a sample of a later one arrives, from what
    had come by then; samples that come later for a written bucket are not in it."""
    b = bucket("ts", width, alignment)
    rows = samples.withColumn("_b", b)
    # the greatest bucket that has come before a row: a row behind it is late
    seen = running_max(rows, ["key"], order, "_b", "_open")
    kept = seen.where(F.col("_open").isNull() | (F.col("_b") >= F.col("_open")))
    return downsample(kept.drop("_b", "_open"), aggregate, width, alignment)


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, n: int = 64) -> DataFrame:
    """df with the greatest value before each row in its key's order, in two steps as running sums are."""
    cut = df.withColumn("_range", ranges(df, F.col(order), n))
    tops = cut.groupBy(*keys, "_range").agg(F.max(value).alias("_top"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.max("_top").over(w).alias("_before"))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.max(value).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = cut.withColumn("_inside", inside).join(before, on)
    return joined.select(*df.columns, F.greatest("_inside", "_before").alias(out))
