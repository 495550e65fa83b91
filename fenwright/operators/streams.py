"""Append logs, tables of (key, ms, seq, ...), and consumer groups with pending entries (key, grp, ms, seq, consumer, delivered_at, deliveries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["key", "ms", "seq"]


def _id(ms: str = "ms", seq: str = "seq") -> Column:
    return F.struct(F.col(ms).alias("ms"), F.col(seq).alias("seq"))


def _at(i: tuple[int, int]) -> Column:
    return F.struct(F.lit(i[0]).cast("bigint").alias("ms"), F.lit(i[1]).cast("bigint").alias("seq"))


def between(log: DataFrame, start: tuple[int, int] | None = None, stop: tuple[int, int] | None = None, open_start: bool = False, open_stop: bool = False) -> DataFrame:
    out = log
    if start is not None:
        out = out.where(_id() > _at(start)) if open_start else out.where(_id() >= _at(start))
    if stop is not None:
        out = out.where(_id() < _at(stop)) if open_stop else out.where(_id() <= _at(stop))
    return out


def number(log: DataFrame, ms: str = "ms", order: str = "order") -> DataFrame:
    """Gives entries of one millisecond the sequence 0, 1, ... in arrival order."""
    return log.withColumn("seq", (F.row_number().over(Window.partitionBy("key", ms).orderBy(order)) - 1).cast("bigint"))


def trim_length(log: DataFrame, most: int) -> DataFrame:
    """The newest entries of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def trim_before(log: DataFrame, first: tuple[int, int]) -> DataFrame:
    return log.where(_id() >= _at(first))


def read(log: DataFrame, cursors: DataFrame, count: int | None = None) -> DataFrame:
    """Entries behind each key's cursor (key, last_ms, last_seq), oldest first up to count."""
    out = log.join(cursors, "key").where(_id() > _id("last_ms", "last_seq")).drop("last_ms", "last_seq")
    if count is None:
        return out
    w = Window.partitionBy("key").orderBy("ms", "seq")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")


def deliver(log: DataFrame, groups: DataFrame, consumer: str, now_ms: int, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New entries for groups (key, grp, last_ms, last_seq): the pending rows, and the groups moved on."""
    fresh = log.join(groups, "key").where(_id() > _id("last_ms", "last_seq"))
    if count is not None:
        w = Window.partitionBy("key", "grp").orderBy("ms", "seq")
        fresh = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count)
    pending = fresh.select("key", "grp", "ms", "seq", F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("bigint").alias("delivered_at"), F.lit(1).alias("deliveries"))
    seen = pending.groupBy("key", "grp").agg(F.max(_id()).alias("_m"))
    moved = groups.join(seen, ["key", "grp"], "left").select(
        "key", "grp", F.coalesce("_m.ms", "last_ms").alias("last_ms"), F.coalesce("_m.seq", "last_seq").alias("last_seq")
    )
    return pending, moved


def acknowledge(pending: DataFrame, acks: DataFrame) -> DataFrame:
    return pending.join(acks.select("key", "grp", "ms", "seq"), ["key", "grp", "ms", "seq"], "left_anti")


def delete(log: DataFrame, gone: DataFrame) -> DataFrame:
    return log.join(gone.select(*ID), ID, "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def claim(pending: DataFrame, consumer: str, now_ms: int, min_idle: int) -> DataFrame:
    """Hands entries that are idle for min_idle ms to the consumer."""
    idle = F.lit(now_ms) - F.col("delivered_at") >= min_idle
    return pending.select(
        "key", "grp", "ms", "seq",
        F.when(idle, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(idle, F.lit(now_ms)).otherwise(F.col("delivered_at")).cast("bigint").alias("delivered_at"),
        (F.col("deliveries") + idle.cast("int")).alias("deliveries"),
    )


def group_lag(log: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries that a group has not been given yet."""
    behind = log.join(groups, "key").where(_id() > _id("last_ms", "last_seq")).groupBy("key", "grp").agg(F.count("*").alias("lag"))
    return groups.select("key", "grp").join(behind, ["key", "grp"], "left").withColumn("lag", F.coalesce("lag", F.lit(0)))


def info(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("length"), F.min(_id()).alias("first"), F.max(_id()).alias("last"))


def routes(messages: DataFrame, patterns: DataFrame, most: int = 10_000) -> DataFrame:
    """Messages (channel, ...) with every subscription (pattern as a regex) that matches.

    A pattern has no key to join on, so patterns are broadcast, in blocks of about `most` rows where there are more.
    """
    blocks = max(1, -(-patterns.count() // most))
    out = None
    for i in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i) if blocks > 1 else patterns
        hit = messages.join(F.broadcast(part), F.expr("channel rlike pattern"))
        out = hit if out is None else out.unionAll(hit)
    return out


def delete_by_reference(log: DataFrame, pending: DataFrame, gone: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    """The log and the pending entries after deletion of gone (key, ms, seq).

    KEEPREF: entries go, pending ones stay as they are. DELREF: both go. ACKED: an entry goes
    only when no group has it pending.
    """
    ids = gone.select(*ID).distinct()
    if policy == "KEEPREF":
        return delete(log, ids), pending
    if policy == "DELREF":
        return delete(log, ids), pending.join(ids, ID, "left_anti")
    if policy == "ACKED":
        return delete(log, ids.join(pending.select(*ID), ID, "left_anti")), pending
    raise ValueError(policy)


def acknowledge_delete(log: DataFrame, pending: DataFrame, acks: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    """Acknowledges acks (key, grp, ms, seq) and deletes their entries by the policy; only what was pending counts."""
    known = acks.join(pending.select("key", "grp", *ID[1:]), ["key", "grp", "ms", "seq"], "left_semi")
    return delete_by_reference(log, acknowledge(pending, acks), known, policy)


def claim_ids(pending: DataFrame, wanted: DataFrame, consumer: str, now_ms: int, min_idle: int = 0, just_id: bool = False, retry: int | None = None) -> DataFrame:
    """Pending rows with those of wanted (key, grp, ms, seq) that are idle for min_idle handed to the consumer.

    just_id leaves the number of deliveries; retry sets it.
    """
    mark = wanted.select("key", "grp", "ms", "seq").distinct().withColumn("_w", F.lit(True))
    both = pending.join(mark, ["key", "grp", "ms", "seq"], "left")
    take = F.coalesce(F.col("_w"), F.lit(False)) & (F.lit(now_ms) - F.col("delivered_at") >= min_idle)
    number = F.lit(retry) if retry is not None else F.col("deliveries") + (0 if just_id else 1)
    return both.select(
        "key", "grp", "ms", "seq",
        F.when(take, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(take, F.lit(now_ms)).otherwise(F.col("delivered_at")).cast("bigint").alias("delivered_at"),
        F.when(take, number).otherwise(F.col("deliveries")).cast("int").alias("deliveries"),
    )


def auto_claim(pending: DataFrame, key, grp, consumer: str, now_ms: int, min_idle: int, start: tuple[int, int] = (0, 0), count: int = 100) -> tuple[DataFrame, DataFrame]:
    """The pending rows after up to `count` idle ones from `start` on are claimed, and the next cursor (ms, seq; 0-0 at the end)."""
    of = (F.col("key") == F.lit(key)) & (F.col("grp") == F.lit(grp)) & (_id() >= _at(start))
    idle = pending.where(of & (F.lit(now_ms) - F.col("delivered_at") >= min_idle)).orderBy("ms", "seq")
    page = idle.select("key", "grp", "ms", "seq").limit(count)
    cursor = idle.offset(count).limit(1).agg(F.coalesce(F.min("ms"), F.lit(0)).alias("ms"), F.coalesce(F.min("seq"), F.lit(0)).alias("seq"))
    return claim_ids(pending, page, consumer, now_ms, min_idle), cursor


def pending_range(pending: DataFrame, start: tuple[int, int] | None = None, stop: tuple[int, int] | None = None, consumer: str | None = None, idle: int = 0, now_ms: int | None = None) -> DataFrame:
    """Pending rows in an id range with how long they have been idle."""
    out = between(pending, start, stop)
    if consumer is not None:
        out = out.where(F.col("consumer") == consumer)
    if now_ms is not None:
        out = out.withColumn("idle", F.lit(now_ms) - F.col("delivered_at")).where(F.col("idle") >= idle)
    return out


def redeliver(log: DataFrame, pending: DataFrame, consumer: str, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """A consumer's own pending entries behind an id, with what the log still has of them (null where deleted)."""
    own = pending.where((F.col("consumer") == consumer) & (_id() > _at(after))).select("key", "grp", "ms", "seq")
    return own.join(log, ID, "left")
