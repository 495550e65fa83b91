"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned (PCA, then alternating sign codes and Procrustes steps)
so that the signs of the rotated vectors are balanced bits. Substrings of the
codes are the keys of the tables; vectors that meet in a table are compared by
cosine in double precision, each pair in the first table in which it meets. The
number of tables follows from the substring length and from the angles at which pairs
at the threshold are seen from the mean of the fit sample, so that such a pair is
met with the wished probability; of the lengths, up to the logarithm of the
largest group, the cheapest is taken. Recall is thus the same at every size.

Equal vectors of a label form one class that is compared once. Large
buckets are cut into tiles and tile pairs, so no task holds a bucket. Links are
summed and reduced to spanning edges where they are found; no pair is emitted.

Defined cases: a null label, a null or empty vector, null or non-finite
components and zero vectors link with nothing; vectors of different lengths
do not link; repeated vec_ids with equal vectors count as two vectors and share
their row's result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components, in_groups, local_roots, pairs_within

#: Rows on which the rotations are fitted, chosen by hash.
FIT_ROWS = 10_000
TILE = 256
#: What a row in a table costs, in comparisons, and the most tables looked at.
ROW_COST, MOST_TABLES = 64, 1024


def rotations(x: np.ndarray, count: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean, and matrices whose signs of (v - mean) @ matrix are code bits."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    d = x.shape[1]
    c = x - mean
    basis = np.linalg.svd(c, full_matrices=False)[2].T if len(x) >= d else np.eye(d)
    v = c @ basis
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(basis @ r)
    return mean, out


def plan_tables(largest: int, dims: int, cosine: float, found: float, away: np.ndarray) -> tuple[int, int]:
    """Bits of a key and number of tables for a largest label of so many vectors.

    away: squared distances of unit vectors from the mean. A pair at the threshold is
    seen from there at a wider angle; bits agree by that one. Fewer bits need
    fewer tables with larger buckets; the cheapest pair is taken. No bits mean one table in which all meet.
    """
    away = away if len(away) else np.ones(1)
    agree = 1 - np.arccos(np.clip(1 - (1 - cosine) / np.maximum(away, 1e-12), -1, 1)) / np.pi
    best = (largest + ROW_COST, 0, 1)
    for bits in range(1, min(24, dims, max(4, round(math.log2(max(1, largest) / 4 + 1)))) + 1):
        met = agree**bits
        misses = lambda tables: ((1 - met) ** tables).mean() > 1 - found  # noqa: B023, E731
        low, high = 0, 1
        while misses(high) and high < MOST_TABLES:
            low, high = high, 2 * high
        if misses(high):
            continue
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if misses(mid) else (low, mid)
        best = min(best, (high * (ROW_COST + largest / 2**bits), bits, high))
    return best[1:]


def most_apart(bits: int, cosine: float, away: np.ndarray, lost: float = 0.0005) -> int:
    """Code bits in which pairs at the threshold differ at most, but for a share `lost` of them.

    Bits are not independent, so the spread is taken as twice that of independent ones.
    """
    away = away if len(away) else np.ones(1)
    p = np.arccos(np.clip(1 - (1 - cosine) / np.maximum(away, 1e-12), -1, 1)) / np.pi
    spread = 2 * np.sqrt(np.maximum(bits * p * (1 - p), 1e-9))
    tail = np.frompyfunc(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), 1, 1)
    low, high = 0, bits
    while low < high:
        mid = (low + high) // 2
        if tail((mid + 0.5 - bits * p) / spread).astype(float).mean() <= lost:
            high = mid
        else:
            low = mid + 1
    return low


def near(vectors: DataFrame, cosine: float = 0.93, found: float = 0.995, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding").cast("array<double>")
    bad = F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("label").isNotNull() & ~bad, F.struct(F.xxhash64("label", e).alias("a"), F.hash(e, F.col("label")).alias("b"))).alias("c"),
        F.col("label").cast("string").alias("label"),
        e.alias("v"),
    )
    classes = cut(
        rows.where("c is not null")
        .groupBy("c")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("part", F.xxhash64("label", F.size("v")))
        .withColumn("id", F.xxhash64("c"))
    )
    largest = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    taken = classes.select(F.xxhash64("c", F.lit(3)).alias("h"), "v").orderBy("h").limit(fit_rows).toArrow().column("v").to_pylist()
    dims = max(map(len, taken), default=1)

    def square(v: list[np.ndarray]) -> np.ndarray:
        """Unit vectors, for the codes with as many components as the rotations have."""
        x = np.zeros((len(v), dims))
        for i, y in enumerate(v):
            x[i, : len(y)] = y[:dims]
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]

    sample = square([np.array(v) / np.abs(v).max() for v in taken])
    away = ((sample - sample.mean(0)) ** 2).sum(1) if taken else np.zeros(0)
    bits, tables = plan_tables(largest, dims, cosine, found, away)
    per = max(1, dims // max(1, bits))
    mean, turns = rotations(sample, math.ceil(tables / per))

    total = tables * bits
    apart = most_apart(total, cosine, away) if bits else 0

    def codes(v: list[np.ndarray]) -> np.ndarray:
        """Bits of all tables, `bits` for each."""
        x = square(v) - mean
        out = [(x @ r >= 0)[:, : per * bits] for r in turns]
        return np.concatenate(out, 1)[:, :total] if out and bits else np.zeros((len(v), total), bool)

    def keys(code: np.ndarray) -> np.ndarray:
        return code.reshape(len(code), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(code), tables), np.int64)

    def scaled(column) -> list[np.ndarray]:
        """Vectors over their largest component, so that squares neither overflow nor vanish."""
        return [(lambda y: y / np.abs(y).max())(np.array(x)) for x in column.to_pylist()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                code = codes(scaled(b.column("v")))
                part, ident = (np.repeat(b.column(c).to_numpy(), tables) for c in ("part", "id"))
                packed = [row.tobytes() for row in np.packbits(code, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part), pa.array(np.tile(np.arange(tables), b.num_rows).astype(np.int32)), pa.array(keys(code).ravel()), pa.array(ident),
                        pa.array([p for p in packed for _ in range(tables)], pa.binary()),
                    ],
                    names=["part", "tab", "key", "id", "code"],
                )

    def tiled(met: DataFrame, keep: list[str]) -> DataFrame:
        """Rows of buckets with several, in tiles and pairs of tiles of bounded size."""
        sizes = met.groupBy(F.col("bucket").alias("k")).count().where("count > 1").select("k", F.expr(f"cast((count + {TILE} - 1) div {TILE} as int)").alias("tiles"))
        own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("tiles")).cast("int")
        return (
            met.join(sizes, F.col("bucket") == F.col("k"))
            .withColumn("own", own)
            .select("bucket", *keep, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
            .select("bucket", *keep, "own", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"))
        )

    def candidates(t: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs that meet in a table for the first time and whose codes are near."""
        n = t.num_rows
        own, tab = t.column("own").to_numpy(), t.column("tab").to_numpy()
        cross = t.column("ta").to_numpy() != t.column("tb").to_numpy()
        packed = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(n, -1)
        k = keys(np.unpackbits(packed, axis=1)[:, :total].astype(bool))
        for i, j in pairs_within(first, n):
            ok = ~cross[i] | (own[i] != own[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(packed[i] ^ packed[j]).sum(1, dtype=np.int64) <= apart
            i, j = i[ok], j[ok]
            ok = (k[i] == k[j]).argmax(1) == tab[i]
            yield i[ok], j[ok]

    def close(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        on = np.zeros(t.num_rows, bool)
        for i, j in candidates(t, first):
            on[i] = on[j] = True
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(on)) for c in ("bucket", "tab", "id", "code")], names=["bucket", "tab", "id", "code"])

    met = classes.select("part", "id", "v").mapInArrow(spread, "part long, tab int, key long, id long, code binary")
    met = cut(met.select(F.xxhash64("part", "tab", "key").alias("bucket"), "tab", "id", "code"))
    some = in_groups(tiled(met, ["tab", "id", "code"]), ["bucket", "ta", "tb"], close, "bucket long, tab int, id long, code binary").distinct()
    held = some.join(classes.select(F.col("id").alias("r"), "copies", "v"), F.col("id") == F.col("r")).drop("r")

    def compare(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        ident, copies = (t.column(c).to_numpy() for c in ("id", "copies"))
        raw = scaled(t.column("v"))
        x = np.zeros((n, max(map(len, raw))))
        for i, u in enumerate(raw):
            x[i, : len(u)] = u / np.sqrt(u @ u)
        links = np.zeros(n, np.int64)
        a, b = [], []
        for i, j in candidates(t, first):
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[ok], j[ok]
            links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
            a.append(i)
            b.append(j)
        if a:
            root = local_roots(n, np.concatenate(a), np.concatenate(b))
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ident[on]), pa.array(ident[root[on]]), pa.array(links[on])], names=["a", "b", "n"])

    linked = cut(in_groups(tiled(held, ["tab", "id", "code", "copies", "v"]), ["bucket", "ta", "tb"], compare, "a long, b long, n long"))
    links = linked.groupBy(F.col("a").alias("node1")).agg(F.sum("n").alias("more"))
    comp = components(linked.select("a", "b"))
    known = cut(
        classes.select("c", "id", "rep", "copies")
        .join(links, F.col("id") == F.col("node1"), "left")
        .join(comp, F.col("id") == F.col("node"), "left")
        .select("c", "rep", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), "component")
    )
    names = known.where("component is not null").groupBy(F.col("component").alias("g")).agg(F.min("rep").alias("least"))
    known = known.join(names, F.col("component") == F.col("g"), "left").select(F.col("c").alias("d"), "n", F.coalesce("least", "rep").alias("m"))
    return rows.select("vec_id", "c").join(known, F.col("c") == F.col("d"), "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("m", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("m", "vec_id"), F.lit(True)).alias("kept"),
    )
