"""Vector sets, tables of (key, element, vector): exact nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2."""
    return (cosine(a, b) + 1.0) / 2.0


def query_vector(values: list[float]) -> Column:
    return F.lit([float(x) for x in values])


def nearest(vectors: DataFrame, query: list[float], count: int = 10, where: Column | None = None, epsilon: float | None = None) -> DataFrame:
    """The count elements of greatest similarity with their scores, ties by element."""
    src = vectors if where is None else vectors.where(where)
    out = src.select("element", similarity(F.col("vector"), query_vector(query)).alias("score"))
    if epsilon is not None:
        out = out.where(F.col("score") >= 1.0 - epsilon)
    return out.orderBy(F.col("score").desc(), "element").limit(count)


def set_attributes(vectors: DataFrame, delta: DataFrame) -> DataFrame:
    """vectors (key, element, ..., attr JSON text) with the attributes of delta (key, element, attr); "" removes. Unknown elements are left out."""
    new = delta.select("key", "element", F.col("attr").alias("_attr"), F.lit(True).alias("_set"))
    out = vectors.join(new, ["key", "element"], "left")
    attr = F.when(F.col("_set"), F.nullif("_attr", F.lit(""))).otherwise(F.col("attr"))
    return out.select(*[attr.alias(c) if c == "attr" else F.col(c) for c in vectors.columns])


def attributes(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, element, attr) of every wanted row, null where there is none."""
    return wanted.select("key", "element").join(vectors.select("key", "element", "attr"), ["key", "element"], "left")


def attribute(name: str) -> Column:
    """A top-level attribute as text, for conditions of `nearest`; null where it is missing."""
    return F.get_json_object("attr", f"$['{name}']")


def within(vectors: DataFrame, query: list[float], distance: float) -> DataFrame:
    """Elements whose 1 - cosine is at most the distance."""
    d = F.lit(1.0) - cosine(F.col("vector"), query_vector(query))
    return vectors.select("element", d.alias("distance")).where(F.col("distance") <= distance)


BLOCK = 4096  # rows of a side of a block of pairs
TILE = 256  # wanted rows whose pairs with a block are in memory at once


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, zeros behind their ends, and their lengths; -1 for null or with a null in it."""
    out, sizes = np.zeros((len(column), width)), np.full(len(column), -1)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and None not in v:
            out[i, : len(v)], sizes[i] = v, len(v)
    return out, sizes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added in order as `dot` adds them."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _best(left: pa.Table, right: pa.Table, count: int) -> pa.Table:
    """The nearest of a block for each wanted row. Products of matrices choose pairs, those near the last place included; `dot` decides."""
    names, kinds = ["key", "of", "element", "score"], [left["key"].type, left["element"].type, left["element"].type, pa.float64()]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    width = max(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (left["vector"], right["_vector"]))
    (a, na), (b, nb) = _matrix(left["vector"], width), _matrix(right["_vector"], width)
    codes = pa.chunked_array(left["element"].chunks + right["of"].cast(left["element"].type).chunks).combine_chunks().dictionary_encode()
    rank = np.empty(len(codes.dictionary), np.int64)
    rank[pc.array_sort_indices(codes.dictionary).to_numpy()] = np.arange(len(rank))
    place = rank[codes.indices.to_numpy()]
    pa_, pb = place[: len(a)], place[len(a) :]
    with np.errstate(all="ignore"):
        la, lb = _dots(a, a), _dots(b, b)
        plain = width and len({*na, *nb}) == 1 and na[0] >= 0 and all(np.isfinite(x).all() and (x > 1e-100).all() and (x < 1e100).all() for x in (la, lb))
        ua, ub = (a / np.sqrt(la)[:, None], b / np.sqrt(lb)[:, None]) if plain else (a, b)
        of, element, scores = [], [], []
        for s in range(0, len(b), TILE):
            other = pb[s : s + TILE, None] != pa_
            if plain and len(a) > count + 1:
                near = np.where(other, ub[s : s + TILE] @ ua.T, -2.0)
                least = np.partition(near, len(a) - count, axis=1)[:, len(a) - count]
                q, v = np.nonzero(other & (near >= least[:, None] - 1e-9))
            else:
                q, v = np.nonzero(other)
            q += s
            size = np.sqrt(la[v] * lb[q])
            long = (size > 0) | np.isnan(size)  # as Spark compares
            score = (np.where(long, _dots(a[v], b[q]) / size, 0.0) + 1.0) / 2.0
            score[(na[v] < 0) | (nb[q] < 0)] = 0.5
            null = (na[v] >= 0) & (nb[q] >= 0) & (na[v] != nb[q]) & long
            order = np.lexsort((pa_[v], -np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score)), q))
            q, v, score, null = q[order], v[order], score[order], null[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < count
            of.append(q[keep])
            element.append(v[keep])
            scores.append(pa.array(score[keep], pa.float64(), mask=null[keep]))
    q, v = np.concatenate(of), np.concatenate(element)
    return pa.table([right["_key"].take(q), right["of"].take(q), left["element"].take(v), pa.chunked_array(scores, pa.float64())], names)


def neighbours(vectors: DataFrame, wanted: DataFrame, count: int = 10) -> DataFrame:
    """For every wanted element, its nearest others within the key: a stated query set against all rows of its key.

    All pairs are compared, in blocks of about BLOCK rows a side, so tasks are many and their memory is bounded
    whatever the size of a key; of a block only the nearest of each wanted element go on.
    """
    src = vectors.select("key", "element", "vector").where(F.col("key").isNotNull() & F.col("element").isNotNull())
    q = src.join(wanted.select("key", "element"), ["key", "element"], "left_semi").withColumnRenamed("element", "of")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = src.groupBy("key").agg(F.count("*").alias("_n")).join(q.groupBy("key").agg(F.count("*").alias("_m")), "key").select("key", blocks("_n").alias("_nv"), blocks("_m").alias("_nq"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = src.join(sizes, "key").select("key", "element", "vector", part("element", "_nv").alias("_v"), each("_nq").alias("_q"))
    right = q.join(sizes, "key").select(F.col("key").alias("_key"), "of", F.col("vector").alias("_vector"), part("of", "_nq").alias("_qq"), each("_nv").alias("_vv"))
    kind = dict(src.dtypes)
    best = left.groupBy("key", "_v", "_q").cogroup(right.groupBy("_key", "_vv", "_qq")).applyInArrow(
        lambda a, b: _best(a, b, count), f"key {kind['key']}, of {kind['element']}, element {kind['element']}, score double"
    )
    w = Window.partitionBy("key", "of").orderBy(F.col("score").desc(), "element")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def info(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("key").agg(F.count("*").alias("size"), F.max(F.size("vector")).alias("dim"))
