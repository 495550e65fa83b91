"""Ordered lists as array columns: indexes from 0, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    at = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    to = F.least(n - 1, F.lit(stop) if stop >= 0 else n + stop)
    return at, to


def push_left(a, *values) -> Column:
    return F.concat(F.array(*[F.lit(v) for v in reversed(values)]), col(a))


def push_right(a, *values) -> Column:
    return F.concat(col(a), F.array(*[F.lit(v) for v in values]))


def list_range(a, start: int, stop: int) -> Column:
    a = col(a)
    at, to = _bounds(F.size(a), start, stop)
    return F.when(at > to, F.slice(a, 1, 0)).otherwise(F.slice(a, at + 1, to - at + 1))


def pop_left(a, n: int = 1) -> tuple[Column, Column]:
    """What is popped, and what remains."""
    return list_range(a, 0, n - 1) if n else F.slice(col(a), 1, 0), list_range(a, n, -1)


def pop_right(a, n: int = 1) -> tuple[Column, Column]:
    return (F.reverse(list_range(a, -n, -1)) if n else F.slice(col(a), 1, 0)), (list_range(a, 0, -n - 1) if n else col(a))


def index(a, i: int) -> Column:
    a = col(a)
    return F.get(a, i) if i >= 0 else F.get(a, F.size(a) + i)


def set_at(a, i: int, value) -> Column:
    """Null where the index is out of range."""
    a = col(a)
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.when((at >= 0) & (at < F.size(a)), F.transform(a, lambda x, k: F.when(k == at, F.lit(value)).otherwise(x)))


def remove(a, count: int, value) -> Column:
    """Removes the first count equal elements, the last -count ones, or all for 0."""
    a = col(a)
    if count == 0:
        return F.filter(a, lambda x: ~x.eqNullSafe(F.lit(value)))
    src = a if count > 0 else F.reverse(a)
    hits = F.filter(F.transform(src, lambda x, i: F.when(x == F.lit(value), i)), lambda x: x.isNotNull())
    out = F.filter(src, lambda x, i: ~F.array_contains(F.slice(hits, 1, abs(count)), i))
    return out if count > 0 else F.reverse(out)


def insert(a, before: bool, pivot, value) -> Column:
    """Before or after the first pivot; the list itself without one."""
    a = col(a)
    at = F.array_position(a, F.lit(pivot)).cast("int")
    cut = at - 1 if before else at
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), cut), F.array(F.lit(value)), F.slice(a, cut + 1, F.size(a))))


def positions(a, value, rank: int = 1, count: int = 0, maxlen: int = 0) -> Column:
    """Indexes of equal elements: from the rank-th match on (from the end if negative), count of them (0: all)."""
    a = col(a)
    all_ = F.filter(F.transform(a, lambda x, i: F.when(x == F.lit(value), i)), lambda x: x.isNotNull())
    if maxlen:
        all_ = F.filter(all_, lambda i: i < maxlen) if rank > 0 else F.filter(all_, lambda i: i >= F.size(a) - maxlen)
    order = all_ if rank > 0 else F.reverse(all_)
    return F.slice(order, abs(rank), count or 1 << 30)


def length(a) -> Column:
    return F.size(col(a))


def pop_many(a, n: int, right: bool = False) -> Column:
    """Struct (popped, rest) of n elements from an end; popped stand in the order in which they go."""
    c = col(a)
    k = F.least(F.lit(n), F.size(c))
    if right:
        return F.struct(F.reverse(F.slice(c, F.size(c) - k + 1, k)).alias("popped"), F.slice(c, F.lit(1), F.size(c) - k).alias("rest"))
    return F.struct(F.slice(c, F.lit(1), k).alias("popped"), F.slice(c, k + 1, F.size(c)).alias("rest"))
