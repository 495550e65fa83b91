"""Connected components and grouped streams, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a long, b long).

    Alternates large-star and small-star steps until the edges are stars; each
    step is a minimum by node and a join, so a node with very many neighbours is
    pre-aggregated and its join can be split. Edges stay in Spark.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = large.distinct()
        low = e2.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = e2.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def in_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, rows: int = 20_000) -> DataFrame:
    """Runs over whole groups of equal keys, many small groups at a time.

    run gets a table that holds complete groups in order and the first row of each group.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def starts(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in keys:
                x = t.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(new)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= rows:
                t = pa.Table.from_batches(held).combine_chunks()
                at = starts(t)
                if len(at) > 1:
                    yield from run(t.slice(0, at[-1]), at[:-1])
                    t = t.slice(at[-1])
                held, size = t.to_batches(), t.num_rows
                rows_left = size
                if rows_left >= rows:  # one group fills it: wait for as much again
                    size = 0
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from run(t, starts(t))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def pairs_within(first: np.ndarray, n: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) inside each group; with side, only those with different sides, unless a group has one side."""
    group = np.zeros(n, np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    size = np.diff(np.append(first, n))
    cross = None
    if side is not None:
        cross = side
    live = np.arange(n)
    end = (first + size)[group]
    for off in range(1, int(size.max()) if n else 0):
        live = live[live + off < end[live]]
        if not len(live):
            return
        i, j = live, live + off
        if cross is not None:
            ok = cross[i] != cross[j]
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
