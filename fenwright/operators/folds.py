"""Ordered folds over an operation log, one aggregate a key: counters with bounds, locks, idempotency keys, job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(log: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return log.groupBy(key).agg(rows.alias("ops"))


def bounded_counter(log: DataFrame, low: int, high: int, key: str = "key", order: str = "seq", delta: str = "delta") -> DataFrame:
    """(key, value, applied): an addition that would leave [low, high] is not applied."""

    def step(a: Column, x: Column) -> Column:
        new = a["value"] + x[delta]
        ok = new.between(low, high)
        return F.struct(F.when(ok, new).otherwise(a["value"]).alias("value"), (a["applied"] + ok.cast("bigint")).alias("applied"))

    zero = F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("applied"))
    return _ordered(log.withColumn(delta, F.col(delta).cast("bigint")), key, order, delta).select(key, F.aggregate("ops", zero, step).alias("s")).select(key, "s.value", "s.applied")


def locks(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, owner, expires_at, fence) after acquire, renew and release (key, seq, op, owner, now, ttl) operations."""

    def step(a: Column, x: Column) -> Column:
        free = a["owner"].isNull() | (a["expires_at"] <= x["now"])
        mine = ~free & (a["owner"] == x["owner"])
        take, renew, drop = (x["op"] == "acquire") & free, (x["op"] == "renew") & mine, (x["op"] == "release") & mine
        owner = F.when(take, x["owner"]).when(drop, F.lit(None)).otherwise(a["owner"])
        until = F.when(take | renew, x["now"] + x["ttl"]).when(drop, F.lit(None)).otherwise(a["expires_at"])
        return F.struct(owner.alias("owner"), until.cast("bigint").alias("expires_at"), (a["fence"] + F.coalesce(take, F.lit(False)).cast("bigint")).alias("fence"))

    zero = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(None).cast("bigint").alias("expires_at"), F.lit(0).cast("bigint").alias("fence"))
    log = log.withColumns({"now": F.col("now").cast("bigint"), "ttl": F.col("ttl").cast("bigint")})
    return _ordered(log, key, order, "op", "owner", "now", "ttl").select(key, F.aggregate("ops", zero, step).alias("s")).select(key, "s.*")


def idempotent(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, state, result): begin, commit and abort in order; a committed key stays."""

    def step(a: Column, x: Column) -> Column:
        open_ = a["state"].isNull()
        begun = a["state"] == "begun"
        state = F.when((x["op"] == "begin") & open_, "begun").when((x["op"] == "commit") & begun, "committed").when((x["op"] == "abort") & begun, F.lit(None)).otherwise(a["state"])
        return F.struct(state.alias("state"), F.when((x["op"] == "commit") & begun, x["result"]).otherwise(a["result"]).alias("result"))

    zero = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("result"))
    return _ordered(log, key, order, "op", "result").select(key, F.aggregate("ops", zero, step).alias("s")).select(key, "s.*")


def queue_states(log: DataFrame, now: int, visibility: int, item: str = "item", order: str = "seq") -> DataFrame:
    """(item, state): waiting, active or done from push, pop, ack and nack; a pop older than the visibility time waits again."""
    w = Window.partitionBy(item).orderBy(F.desc(order))
    last = log.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    state = F.when(F.col("op") == "ack", "done").when((F.col("op") == "pop") & (F.col("at") + visibility > now), "active").otherwise("waiting")
    return last.select(item, state.alias("state"))


def queue_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))
