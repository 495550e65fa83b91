"""Ranked sets, tables of (key, member, score): ranks, ranges, pops, weighted algebra, leaderboards, external sort.

The order of a set is (score, member bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import running


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def rank(df: DataFrame, reverse: bool = False, out: str = "rank") -> DataFrame:
    """0-based rank of every member within its key, by prefix sums over runs of the scores, so that a key may hold most rows."""
    by = -F.col("score").cast("double") if reverse else F.col("score")
    counted = running(df, ["key"], _order(reverse), F.lit(1), "_rank", by)
    return counted.select(*[c for c in df.columns if c != out], (F.col("_rank") - 1).cast("bigint").alias(out))


def add(base: DataFrame, delta: DataFrame, condition: str | None = None) -> DataFrame:
    """Upsert of scores. NX: new members only; XX: known ones only; GT, LT: known ones only if greater, less; INCR: added."""
    new = delta.select("key", "member", F.col("score").alias("_new"))
    both = base.join(new, ["key", "member"], "full_outer")
    old, score = F.col("score"), F.col("_new")
    picked = {
        None: F.coalesce(score, old),
        "NX": F.coalesce(old, score),
        "XX": F.when(old.isNotNull(), F.coalesce(score, old)),
        "GT": F.greatest(old, score),
        "LT": F.least(old, score),
        "INCR": F.coalesce(old, F.lit(0.0)) + F.coalesce(score, F.lit(0.0)),
    }[condition]
    return both.select("key", "member", picked.alias("score")).where("score is not null")


def score_bounds(low: float | None = None, high: float | None = None, open_low: bool = False, open_high: bool = False) -> Column:
    s, out = F.col("score"), F.lit(True)
    if low is not None:
        out &= (s > low) if open_low else (s >= low)
    if high is not None:
        out &= (s < high) if open_high else (s <= high)
    return out


def lex_bounds(low: str = "-", high: str = "+") -> Column:
    """Lexical range: - and + are open ends, [x includes x, (x does not."""
    m, out = F.col("member").cast("string"), F.lit(True)
    if low == "+" or high == "-":
        return F.lit(False)
    if low != "-":
        out &= (m >= low[1:]) if low[0] == "[" else (m > low[1:])
    if high != "+":
        out &= (m <= high[1:]) if high[0] == "[" else (m < high[1:])
    return out


def range_by_rank(df: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Inclusive slice by rank in every key; negative ranks count from the end."""
    w = Window.partitionBy("key")
    r = rank(df, reverse)
    if start < 0 or stop < 0:
        r = r.withColumn("_n", F.count("*").over(w))
    at = F.lit(start) if start >= 0 else F.greatest(F.lit(0), F.col("_n") + start)
    to = F.lit(stop) if stop >= 0 else F.col("_n") + stop
    return r.where((F.col("rank") >= at) & (F.col("rank") <= to)).drop("_n")


def range_by(df: DataFrame, bounds: Column, reverse: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """Members within bounds in order, from offset on, count of them (negative: all), in every key."""
    if offset < 0:
        return df.where("false")
    hit = df.where(bounds)
    if not offset and count < 0:
        return hit
    r = rank(hit, reverse, "_r")
    out = r.where((F.col("_r") >= offset) & ((F.col("_r") < offset + count) if count >= 0 else F.lit(True)))
    return out.drop("_r")


def remove_by_rank(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.join(range_by_rank(df, start, stop).select("key", "member"), ["key", "member"], "left_anti")


def remove_by(df: DataFrame, bounds: Column) -> DataFrame:
    return df.where(~bounds)


def counts(df: DataFrame, bounds: Column | None = None) -> DataFrame:
    return (df if bounds is None else df.where(bounds)).groupBy("key").agg(F.count("*").alias("n"))


def pop(df: DataFrame, n: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The n lowest (highest) members of every key, and what remains."""
    r = rank(df, highest, "_r")
    return r.where(F.col("_r") < n).drop("_r"), r.where(F.col("_r") >= n).drop("_r")


def pop_first(df: DataFrame, keys: list, n: int = 1, highest: bool = False) -> DataFrame:
    """Pops from the first of keys that has members."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    first = df.where(F.col("key").isin(list(keys))).agg(F.min(place).alias("_p"))
    of = df.where(F.col("key").isin(list(keys))).withColumn("_p", place).join(F.broadcast(first), "_p").drop("_p")
    return of.orderBy(*_order(highest)).limit(n)


def _weighted(df: DataFrame, keys: list, weights: list[float] | None) -> DataFrame:
    pairs = [x for k, w in zip(keys, weights or [1.0] * len(keys), strict=True) for x in (F.lit(k), F.lit(float(w)))]
    w = F.create_map(*pairs)[F.col("key")]
    s = F.nanvl(F.col("score") * w, F.lit(0.0)) + F.lit(0.0)
    return df.where(F.col("key").isin(list(keys))).select("key", "member", s.alias("s"), w.alias("w"))


def _combine(aggregate: str) -> Column:
    return {"SUM": F.nanvl(F.sum("s"), F.lit(0.0)), "MIN": F.min("s"), "MAX": F.max("s"), "COUNT": F.sum("w")}[aggregate]


def union(df: DataFrame, keys: list, weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    return _weighted(df, keys, weights).groupBy("member").agg(_combine(aggregate).alias("score"))


def intersect(df: DataFrame, keys: list, weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    out = _weighted(df, keys, weights).groupBy("member").agg(_combine(aggregate).alias("score"), F.count_distinct("key").alias("_n"))
    return out.where(F.col("_n") == len(set(keys))).drop("_n")


def difference(df: DataFrame, keys: list) -> DataFrame:
    """Members of the first key and no other, with their own scores."""
    first = F.col("key") == keys[0]
    out = df.where(F.col("key").isin(list(keys))).groupBy("member").agg(F.max(F.when(first, F.col("score"))).alias("score"), F.bool_and(first).alias("_only"))
    return out.where("_only").drop("_only")


def from_set(members: DataFrame) -> DataFrame:
    """A plain set as a ranked one: every score is 1."""
    return members.select("key", "member", F.lit(1.0).alias("score"))


def submit(log: DataFrame, keep: str = "max") -> DataFrame:
    """Leaderboard from submissions (key, member, score, seq): best, worst or last score."""
    pick = {"max": F.max("score"), "min": F.min("score"), "replace": F.max_by("score", "seq")}[keep]
    return log.groupBy("key", "member").agg(pick.alias("score"))


def around(df: DataFrame, member, radius: int, reverse: bool = True) -> DataFrame:
    """Members whose rank is within radius of the member's, in its keys."""
    r = rank(df, reverse)
    me = r.where(F.col("member") == F.lit(member)).select("key", F.col("rank").alias("_me"))
    return r.join(me, "key").where(F.abs(F.col("rank") - F.col("_me")) <= radius).drop("_me")


def sort_external(
    source: DataFrame, element: str, weights: DataFrame | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, count: int = -1, get: dict[str, DataFrame] | None = None, sort: bool = True
) -> DataFrame:
    """Elements in the order of external weights, with looked-up columns.

    weights: (element, weight), one row per element; none: the elements themselves. A
    missing weight is 0, or first when alpha. Ties go by element bytes, and descending
    turns both. get: column name -> (element, value). Both are left joins, so the optimiser broadcasts small sides;
    the page is cut before the look-ups and put in order again after them, as a join does not keep an order.
    """
    e = F.col(element).cast("string")
    if weights is None:
        out = source.withColumn("_w", e if alpha else F.coalesce(e.try_cast("double"), F.lit(0.0)))
    else:
        w = weights.select(F.col(weights.columns[0]).alias(element), F.col(weights.columns[1]).alias("_v"))
        out = source.join(w, element, "left").withColumn("_w", F.coalesce(F.col("_v").cast("string"), F.lit("")) if alpha else F.coalesce(F.col("_v").cast("string").try_cast("double"), F.lit(0.0))).drop("_v")
    order = [F.col("_w").desc(), e.desc()] if descending else [F.col("_w"), e]
    if sort:
        out = out.orderBy(*order)
    if offset > 0:
        out = out.offset(offset)
    if count >= 0:
        out = out.limit(count)
    for name, table in (get or {}).items():
        out = out.join(table.select(F.col(table.columns[0]).alias(element), F.col(table.columns[1]).alias(name)), element, "left")
    if sort and get:
        out = out.orderBy(*order)
    return out.withColumnRenamed("_w", "weight")
