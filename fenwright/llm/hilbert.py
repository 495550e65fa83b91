"""Hilbert-curve sharding: rows are ordered along a space-filling curve over several
metadata dimensions and cut into runs of equal row counts, so that each shard
covers a compact box and its file statistics prune on every dimension.

A dimension is quantised by its quantiles over all rows (numbers as they are,
strings by their bytes after the common prefix). The curve's cell numbers come
from a table that a rule makes; the global order comes from a range partition
and the position in it, so no task holds a cell, a source or a group of copies.

Defined cases: null text counts as empty (size 16, checksum 0); null dimensions
take the lowest level; ties are ordered by doc_id (null first) and checksum;
fully repeated rows take neighbouring slots; an empty table gives no rows;
columns besides doc_id, text and the dimensions are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_CELL_BITS = 14


def curve_positions(dims: int, bits: int) -> list[int]:
    """Position on the Hilbert curve of each cell; cells are numbered with the first dimension's level as high bits."""
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        # Gray decoding by undoing the rotations and reflections from the top bit down
        top = 1 << bits - 1
        q = top
        while q > 1:
            low = q - 1
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[d]) & low
                    x[0] ^= swap
                    x[d] ^= swap
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        flip, q = 0, top
        while q > 1:
            if x[-1] & q:
                flip ^= q - 1
            q >>= 1
        x = [v ^ flip for v in x]
        place = 0
        for b in range(bits - 1, -1, -1):
            for d in range(dims):
                place = place << 1 | (x[d] >> b & 1)
        out.append(place)
    return out


def _common_prefix(a: str | None, b: str | None) -> int:
    a, b = (a or "").encode(), (b or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _levels(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A level of 0 .. 2**bits - 1 for each dimension, from two aggregates of one row each."""
    kinds = dict(df.dtypes)
    text = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(*[f(d).alias(f"{n}_{i}") for i, d in enumerate(text) for n, f in (("lo", F.min), ("hi", F.max))]).first() if text else {}
    skip = {d: _common_prefix(ends[f"lo_{i}"], ends[f"hi_{i}"]) for i, d in enumerate(text)}

    def number(d: str) -> Column:
        if d not in skip:
            return F.col(d).cast("double")
        six = F.substring(F.encode(F.col(d), "UTF-8"), skip[d] + 1, 6)
        return F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double")

    values = [number(d) for d in dims]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(v, steps, 10_000).alias(f"c{i}") for i, v in enumerate(values)]).first()
    out = []
    for i, v in enumerate(values):
        bounds = cuts[f"c{i}"] or []  # repeated ones too: a dimension of few values spreads over all levels
        level = sum(((v > b).cast("int") for b in bounds), F.lit(0))
        out.append(F.coalesce(level, F.lit(0)))
    return out


ORDER = ["curve", "size", "doc_id", "text_crc32"]


def _measures(dims: tuple[str, ...]) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        *[F.col(d) for d in dims if d != "size"],
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ]


def _curve(slim: DataFrame, dims: tuple[str, ...], bits: int) -> Column:
    cell = F.lit(0)
    for level in _levels(slim, list(dims), bits):
        cell = cell * (1 << bits) + level
    table = F.split(F.lit(",".join(map(str, curve_positions(len(dims), bits)))), ",").cast("array<int>")
    return F.element_at(table, cell + 1)


def shard(docs: DataFrame, n_shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 4, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve (position on the Hilbert curve), shard and slot of each row.

    `size` as a dimension is UTF-8 bytes of the text plus 16. Shards are runs of
    the order and their row counts differ by at most one.
    """
    if len(dims) * bits > MAX_CELL_BITS:
        raise ValueError(f"at most {MAX_CELL_BITS} bits over all dimensions")
    spark = docs.sparkSession
    slim = cut(docs.select(F.col("doc_id"), *_measures(dims)))
    keyed = slim.select("doc_id", "size", "text_crc32", _curve(slim, dims, bits).alias("curve"))
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ORDER
    placed = cut(
        keyed.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("*", F.monotonically_increasing_id().alias("at"))
        .select("*", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth"))
        .drop("at")
    )
    # one row per partition: its rows, and those before it
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("nth")
    number = F.expr(f"((before + nth + 1) * {n_shards} - 1) div total")
    ranked = placed.join(F.broadcast(before), "part").select("doc_id", "size", "text_crc32", "curve", rank.alias("rank"), "total", number.cast("int").alias("shard"))
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.expr(f"(cast(shard as bigint) * total) div {n_shards}")).alias("slot"))


def write(docs: DataFrame, path: str, n_shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 4) -> None:
    """docs as Parquet with one file a shard (folder shard=n) in the order of the curve, and their size in column `size`.

    The shards are those of `shard`, known by their first rows, of which there
    are n_shards; rows that are equal in all of the order stay in one file. Columns of docs named size or shard give way.
    """
    placed = shard(docs, n_shards, dims, bits)
    key = F.struct("curve", "size", F.col("doc_id").cast("long").alias("doc_id"), F.col("text_crc32").cast("long").alias("text_crc32"))
    firsts = placed.groupBy("shard").agg(F.min(key).alias("first"))
    names = [c for c in docs.columns if c not in ("size", "shard", "curve", "text_crc32")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *_measures(dims)[-2:])
    rows = rows.withColumn("curve", _curve(rows, dims, bits))
    bounds = firsts.agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("bounds"))
    held = F.filter("bounds", lambda b: b["first"] <= key)
    found = rows.crossJoin(F.broadcast(bounds)).withColumn("shard", F.element_at(held, -1)["shard"]).drop("bounds")
    found.repartition(n_shards, "shard").sortWithinPartitions("shard", *ORDER).drop("curve", "text_crc32").write.partitionBy("shard").parquet(path)
