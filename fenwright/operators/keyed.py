"""Keyed tables: key lookups, upserts, deletes, expiry, hashes, sets and folds over an operation log.

State is a table; a mutating command is a function from tables to a table. Every
operator is lazy and leaves join and shuffle strategy to the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import pop_many
from ..functions.text import glob


def live(df: DataFrame, now_ms: int, column: str = "expires_at") -> DataFrame:
    """Rows that have not expired: expiry (in ms) is null or later than now."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(now_ms)))


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Last write wins: one row per key, the one of greatest order; columns as in log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those of equal keys (delta has one row per key)."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_present(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return upsert(base, delta.join(base.select(*keys), keys, "left_semi"), keys)


def insert_all_or_nothing(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta is added only if none of its keys exists."""
    clash = delta.join(base.select(*keys), keys, "left_semi").select(F.lit(1).alias("_one")).limit(1)
    free = delta.withColumn("_one", F.lit(1)).join(clash, "_one", "left_anti").drop("_one")
    return base.unionByName(free, allowMissingColumns=True)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def lookup(base: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Every wanted row with what base has of its key, null where it has nothing."""
    return wanted.join(base, keys, "left")


def exists_count(base: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """How many of the wanted keys exist, repeats counted."""
    return wanted.join(base.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def keys_like(df: DataFrame, key: str, pattern: str) -> DataFrame:
    return df.where(glob(key, pattern)).select(key)


def page(df: DataFrame, order: str, cursor: int, count: int, pattern: str | None = None) -> DataFrame:
    """Rows cursor .. cursor + count - 1 of the order, the pattern applied after the cut."""
    out = df.orderBy(order).offset(cursor).limit(count)
    return out.where(glob(order, pattern)) if pattern else out


def rename(df: DataFrame, key: str, source: str, target: str, only_absent: bool = False) -> DataFrame:
    """Moves rows of source to target, over what target has; only_absent: nothing if target exists."""
    moved = df.where(F.col(key) == source).withColumn(key, F.lit(target))
    if only_absent:
        there = df.where(F.col(key) == target).select(F.lit(source).alias(key)).limit(1)
        keep = df.where(F.col(key) == source).join(there, key, "left_semi")
        return df.where(F.col(key) != source).unionByName(keep).unionByName(moved.withColumn("_s", F.lit(source)).join(there.withColumnRenamed(key, "_s"), "_s", "left_anti").drop("_s"))
    source_there = df.where(F.col(key) == source).select(F.lit(target).alias(key)).limit(1)
    rest = df.where(~F.col(key).isin(source, target)).unionByName(df.where(F.col(key) == target).join(source_there, key, "left_anti"))
    return rest.unionByName(moved)


def copy(df: DataFrame, key: str, source: str, target: str, replace: bool = False) -> DataFrame:
    moved = df.where(F.col(key) == source).withColumn(key, F.lit(target))
    if replace:
        return df.where((F.col(key) != target) | (F.lit(source) == target)).unionByName(moved)
    there = df.where(F.col(key) == target).select(key).limit(1)
    return df.unionByName(moved.join(there, key, "left_anti"))


def expire(current: Column | str, when_ms: Column, condition: str | None = None) -> Column:
    """New expiry under NX, XX, GT, LT; no expiry counts as infinity."""
    cur = F.col(current) if isinstance(current, str) else current
    ok = {None: F.lit(True), "NX": cur.isNull(), "XX": cur.isNotNull(), "GT": cur.isNotNull() & (when_ms > cur), "LT": cur.isNull() | (when_ms < cur)}[condition]
    return F.when(ok, when_ms).otherwise(cur)


def ttl(expires: Column | str, now_ms: int, seconds: bool = True) -> Column:
    """Time left; -1 without expiry, -2 where it has passed."""
    e = F.col(expires) if isinstance(expires, str) else expires
    left = e - F.lit(now_ms)
    return F.when(e.isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(F.floor((left + 500) / 1000) if seconds else left).cast("bigint")


def expire_time(expires: Column | str, seconds: bool = True) -> Column:
    e = F.col(expires) if isinstance(expires, str) else expires
    return F.coalesce(F.floor(e / 1000) if seconds else e, F.lit(-1)).cast("bigint")


def ranges(df: DataFrame, order: Column, n: int = 64) -> Column:
    """The number of the run, of about n runs of equal size over the whole table, that a row's order value lies in.

    The cuts are quantiles, one row of fixed size, and then literals: a value lies in the same run in every plan.
    """
    v = order.cast("double")
    cuts = df.agg(F.percentile_approx(v, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []
    return sum(((v > c).cast("int") for c in sorted(set(cuts))), F.lit(0))


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, by: Column | None = None, n: int = 64) -> DataFrame:
    """df with the running sum of value in its key's order, the row included.

    Prefix sums in two steps: inside each run of the order (by: its leading number, ascending), and over
    the runs' totals, of which a key has at most n. No task holds a whole hot key.
    """
    cut = df.withColumn("_value", value).withColumn("_range", ranges(df, by if by is not None else order[0], n))
    totals = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), before.alias("_ahead"))
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumn("_inside", inside).join(ahead, on)
    total = F.when(F.col("_inside").isNull(), F.col("_ahead")).otherwise(F.col("_inside") + F.coalesce("_ahead", F.lit(0)))
    return joined.select(*[F.col(c) for c in df.columns if c != out], total.alias(out))


def running_sum(log: DataFrame, keys: list[str], delta: str, order: str = "seq", out: str = "value") -> DataFrame:
    """Counter value after each operation."""
    return running(log, keys, [F.col(order)], F.col(delta), out)


def persist(df: DataFrame, wanted: DataFrame, keys: list[str], column: str = "expires_at") -> DataFrame:
    """df without the expiry of the wanted keys (of fields, where keys hold a key and a field)."""
    mark = wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    both = df.join(mark, keys, "left")
    return both.select(*[F.when(F.col("_w"), F.lit(None)).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c == column else F.col(c) for c in df.columns])


def put(base: DataFrame, delta: DataFrame, keys: list[str], keep_ttl: bool = False, column: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """A write that returns what it found: the new table, and the old rows of the written keys. keep_ttl leaves an old expiry."""
    old = base.join(delta.select(*keys), keys, "left_semi")
    new = delta
    if keep_ttl:
        held = base.select(*keys, F.col(column).alias("_old"))
        new = delta.drop(column).join(held, keys, "left").withColumnRenamed("_old", column).select(*base.columns)
    return upsert(base, new, keys), old


def clear(df: DataFrame) -> DataFrame:
    """The empty table of the same columns."""
    return df.where(F.lit(False))


def counters(log: DataFrame, keys: list[str], delta: str, out: str = "value") -> DataFrame:
    """Counter value after all operations; null on overflow."""
    return log.groupBy(*keys).agg(F.try_sum(delta).alias(out))


def previous(log: DataFrame, keys: list[str], value: str, order: str = "seq", out: str = "previous") -> DataFrame:
    """What each write found in place (a get-and-set)."""
    return log.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def appended(log: DataFrame, keys: list[str], value: str, order: str = "seq", out: str = "value") -> DataFrame:
    """Appends in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return log.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[value]), "").alias(out))


def as_map(df: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """One map per key."""
    return df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def random_rows(df: DataFrame, n: int, seed: int, partition: str | None = None, repeat: bool = False) -> DataFrame:
    """n random rows (of each partition), distinct or with repeats.

    Without a partition, draws with repeats take places of the whole table: rows are
    numbered by task and place in it, and a task's first place comes from one count a task.
    """
    if repeat and not partition:
        at = df.select("*", F.monotonically_increasing_id().alias("_at"))
        task = F.shiftright("_at", 33)
        counts = at.groupBy(task.alias("_t")).agg(F.count("*").alias("_c"))
        first = counts.select("_t", (F.sum("_c").over(Window.orderBy("_t")) - F.col("_c")).alias("_f"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
        numbered = at.withColumn("_t", task).join(first.select("_t", "_f"), "_t").withColumn("_i", F.col("_f") + F.col("_at").bitwiseAND((1 << 33) - 1))
        total = first.select("_n").limit(1)
        picks = total.select("_n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_d")).select(F.floor(F.rand(seed) * F.col("_n")).cast("bigint").alias("_i"))
        return picks.join(numbered, "_i").drop("_i", "_at", "_t", "_f")
    if repeat:
        w = Window.partitionBy(*([partition] if partition else [])).orderBy(F.lit(0))
        draws = F.explode(F.sequence(F.lit(1), F.lit(n)))
        numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*([partition] if partition else []))))
        picks = numbered.where("_i = 1").select(*([partition] if partition else []), "_n", draws.alias("_d")).withColumn("_i", (F.floor(F.rand(seed) * F.col("_n")) + 1).cast("int"))
        on = ["_i", *([partition] if partition else [])]
        return picks.drop("_n").join(numbered.drop("_n"), on).drop("_i", "_d")
    if partition:
        w = Window.partitionBy(partition).orderBy(F.rand(seed))
        return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
    return df.orderBy(F.rand(seed)).limit(n)


# sets: tables of (key, member)


def set_add(base: DataFrame, members: DataFrame) -> DataFrame:
    return base.select("key", "member").union(members.select("key", "member")).distinct()


def set_move(base: DataFrame, source: str, target: str, member: str) -> DataFrame:
    hit = (F.col("key") == source) & (F.col("member") == F.lit(member))
    return base.withColumn("key", F.when(hit, F.lit(target)).otherwise(F.col("key"))).distinct()


def _of(df: DataFrame, keys: list) -> DataFrame:
    return df.where(F.col("key").isin(list(keys)))


def set_union(df: DataFrame, keys: list) -> DataFrame:
    return _of(df, keys).select("member").distinct()


def set_intersect(df: DataFrame, keys: list) -> DataFrame:
    """Members of all keys: one pre-aggregated shuffle whatever their number."""
    return _of(df, keys).groupBy("member").agg(F.count_distinct("key").alias("_n")).where(F.col("_n") == len(set(keys))).select("member")


def set_difference(df: DataFrame, keys: list) -> DataFrame:
    """Members of the first key and of no other: one pre-aggregated shuffle."""
    return _of(df, keys).groupBy("member").agg(F.bool_and(F.col("key") == keys[0]).alias("_only")).where("_only" if keys[0] not in keys[1:] else "false").select("member")


def set_intersect_count(df: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    n = F.count("*")
    return set_intersect(df, keys).agg((F.least(n, F.lit(limit)) if limit else n).alias("n"))


def store(df: DataFrame, result: DataFrame, target) -> DataFrame:
    """df with the rows of key target replaced by result."""
    return df.where(F.col("key") != F.lit(target)).unionByName(result.withColumn("key", F.lit(target).cast(df.schema["key"].dataType)), allowMissingColumns=True)


def is_member(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, member, ...) with is_member 0 or 1."""
    there = df.select("key", "member").distinct().withColumn("_there", F.lit(1))
    return wanted.join(there, ["key", "member"], "left").withColumn("is_member", F.coalesce("_there", F.lit(0))).drop("_there")


# lists: tables of (key, value array)


def pop_first_list(lists: DataFrame, keys: list, n: int = 1, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pops up to n elements from the first of keys whose list has any: (key, popped), and the lists that remain."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    full = lists.where(F.col("key").isin(list(keys)) & (F.size("value") > 0))
    first = full.agg(F.min_by("key", place).alias("_first"))
    both = lists.join(first, F.col("key") == F.col("_first"), "left").withColumn("_p", F.when(F.col("_first").isNotNull(), pop_many("value", n, right)))
    return (
        both.where("_p is not null").select("key", F.col("_p.popped").alias("popped")),
        both.select("key", F.when(F.col("_p").isNull(), F.col("value")).otherwise(F.col("_p.rest")).alias("value")).where(F.size("value") > 0),
    )


def move_element(lists: DataFrame, source, target, from_right: bool = True, to_right: bool = False) -> DataFrame:
    """Moves an end element of one list to an end of another (or of itself); nothing if the source has none."""
    one = lists.where((F.col("key") == F.lit(source)) & (F.size("value") > 0)).select(F.element_at("value", -1 if from_right else 1).alias("_e"))
    known = lists.unionByName(one.select(F.lit(target).alias("key"), F.array().cast(lists.schema["value"].dataType).alias("value")).join(lists.where(F.col("key") == F.lit(target)).select("key"), "key", "left_anti"))
    both = known.join(one, F.lit(True), "left")
    v, e = F.col("value"), F.col("_e")
    cut = F.when((F.col("key") == F.lit(source)) & e.isNotNull(), F.slice(v, F.lit(1), F.size(v) - 1) if from_right else F.slice(v, F.lit(2), F.size(v))).otherwise(v)
    put_ = F.when((F.col("key") == F.lit(target)) & e.isNotNull(), F.concat(cut, F.array(e)) if to_right else F.concat(F.array(e), cut)).otherwise(cut)
    return both.select("key", put_.alias("value")).where(F.size("value") > 0)
