"""N-gram Jaccard join of whole documents, rare grams first.

Documents with the same set of shingles form one class. Each class puts its
shingles in a global order, rare ones first (by a table of hashed counts over all
documents, whose size is fixed; the order of equal counts is the hash). Two
sets can reach the similarity only if they share a shingle of their prefixes,
and enough of them: what lies behind the shorter-reaching prefix adds no more than
its length. Where few classes meet in a shingle, their pairs are counted and
held against that bound; where many meet, they are chained in order of length,
across the length bound not, and map tasks chain what they hold themselves, so a
frequent shingle costs some rows per task. Few means as many as the counts by hash
may hide: the larger the input, the fuller the table, and a shingle that it cannot
tell from a rare one stands in any prefix; chained, such shingles would join all
documents into one block. Pairs and chains make blocks. The sets
of blocks' classes are then
compared: inside tiles of bounded size, pairs come from the prefix index, pass
the positional bound at their first shared shingle and a suffix bound (parity
sketches of the sets, whose difference never exceeds the sets' difference), and are
verified exactly. A block of several tiles is compared in two rounds. In the first
each tile is compared by itself, with some pivots of the block in all of its tiles,
so a large group of near copies becomes one component and its sets are sent once. In
the second, tiles are compared with each other, but not those of one component.
A pair whose classes are already joined is left out, since it could not change a
component.

Shingles and classes are compared by 64-bit hash.

Defined cases: documents without words (null, empty, blank) have no shingles and
are their own components; documents with fewer words than a shingle have their whole
sequence as one; repeated rows are equal documents; a null doc_id takes part but
names no component unless all are null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, bit_test, bitmap_of, cut, has_bit, hashes, release, row_key
from .graph import components, in_groups, pairs_within

RARITY_BITS = 22
CHUNK = 4096
FLUSH = 500_000
FEW = 16  # classes of a shingle that are paired, or as many as the rarity table may hide; more are chained
WORDS = 60_000  # whose hashes a task keeps
PAIRS = 1_000_000  # that a task holds before it sums them up
TILE, TILE_SHINGLES = 128, 500_000
PIVOTS = 8  # classes, on average, that are in all tiles of a block
SKETCH_BITS = 1024
MAP_BITS = 24  # of the fixed-size filter that spares reading sets of documents without a partner

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of a word-hash sequence, sorted."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return _mix((words * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out += words[i : n - width + 1 + i] * _ODD[i]
    return np.unique(_mix(out))


def _sets(texts: list[bytes], width: int, cache: dict) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingle_set(hashes(t.lower().split(), cache, WORDS), width)


def _class(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts as bytes, in 1 or 4 bytes each, compressed."""
    small = bool(counts.max(initial=0) < 256)
    return bytes([small]) + zlib.compress(counts.astype("u1" if small else "<u4").tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "u1" if data[0] else "<u4").astype(np.uint64)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (row_key, doc_id, class, n) and, a few per task, of the counts by hash (chunk, salt, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        table = np.zeros(1 << RARITY_BITS, np.uint32)
        schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cls, n = [], []
                for s in _sets(binary_column(b, "text"), width, cache):
                    n.append(len(s))
                    cls.append(_class(s) if len(s) else None)
                    np.add.at(table, _slot(s), 1)
                none = lambda kind: pa.nulls(b.num_rows, kind)
                yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("doc_id"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary())], schema=schema)
        if table.any():
            parts = table.reshape(-1, CHUNK)
            m, salt = len(parts), TaskContext.get().partitionId() % 16
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, salt, np.int32)), pa.array([_squeeze(p) for p in parts], pa.binary())], schema=schema
            )

    return docs.mapInArrow(run, "row_key long, doc_id long, class long, n long, chunk int, salt int, data binary")


def _summed(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row of counts for each group; rows are unpacked one at a time, since a batch may have thousands of them."""
    data, out = t.column("data"), []
    for lo, hi in zip(first, np.append(first[1:], t.num_rows), strict=True):
        total = np.zeros(CHUNK, np.uint64)
        for i in range(int(lo), int(hi)):
            total += _counts(data[i].as_py())
        out.append(_squeeze(np.minimum(total, 0xFFFFFFFF)))
    yield pa.RecordBatch.from_arrays([t.column("chunk").take(pa.array(first)).combine_chunks(), pa.array(np.zeros(len(first), np.int32)), pa.array(out, pa.binary())], names=["chunk", "salt", "data"])


def _rarity(survey: DataFrame) -> np.ndarray:
    """Counts by hash over all documents: 2 ** RARITY_BITS numbers for any input."""
    some = survey.where("data is not null").select("chunk", "salt", "data")
    kinds = "chunk int, salt int, data binary"
    total = in_groups(in_groups(some, ["chunk", "salt"], _summed, kinds, 500), ["chunk"], _summed, kinds, 500).collect()
    out = np.zeros((1 << RARITY_BITS) // CHUNK * CHUNK, np.uint32).reshape(-1, CHUNK)
    for r in total:
        out[r["chunk"]] = _counts(bytes(r["data"]))
    return out.ravel()


def _ordered(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Shingles in the global order; s is sorted, so a stable sort by count leaves ties in hash order."""
    return s[np.argsort(rarity[_slot(s)], kind="stable")]


def _few(rarity: np.ndarray) -> int:
    """Classes of a shingle that the counts by hash may hide: three standard deviations of what else is in its slot."""
    return max(FEW, int(3 * np.sqrt(rarity.mean())))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _chains(gram: np.ndarray, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Joins rows of one shingle whose lengths are within the bound, into (gram, class, lo, hi) chains and edges.

    Rows in order of length: where even neighbours are out of bound, no pair across that place can link.
    """
    o = np.argsort(gram, kind="stable")
    g = gram[o]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    single = new & np.append(new[1:], True)
    alone = o[single]
    o = o[~single]
    o = o[np.lexsort((cls[o], lo[o], gram[o]))]
    if not len(o):
        return (gram[alone], cls[alone], lo[alone], hi[alone]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, c, a, b = gram[o], cls[o], lo[o], hi[o].copy()
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    # running maximum of hi inside each shingle's rows
    group = np.cumsum(~same)
    most = np.maximum.accumulate(b.astype(np.int64) + group * (1 << 40)) - group * (1 << 40)
    link = same.copy()
    link[1:] &= most[:-1] * 100 >= a[1:].astype(np.int64) * percent
    start = np.flatnonzero(~link)
    head = np.repeat(start, np.diff(np.append(start, len(g))))
    out = g[start], c[start], a[start], np.maximum.reduceat(b, start)
    merge = c[head] != c
    return tuple(np.concatenate([x[alone], y]) for x, y in zip((gram, cls, lo, hi), out, strict=True)), c[head][merge], c[merge]


_EDGE = -1
_MERGED = 1 << 62


def _meeting(a: np.ndarray, b: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b), pa.array(meta)], names=["a", "b", "meta"])


def _split_few(gram: np.ndarray, barred: np.ndarray, most: int) -> np.ndarray:
    """Whether each row's shingle has at most `most` rows, none of them barred."""
    o = np.argsort(gram, kind="stable")
    g = gram[o]
    new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    few = (np.bincount(group) <= most) & (np.bincount(group, weights=barred[o]) == 0) if len(g) else new
    out = np.zeros(len(g), bool)
    out[o] = few[group]
    return out


def _edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return np.ascontiguousarray(e[:, 0]), np.ascontiguousarray(e[:, 1])


def _counted(gram: np.ndarray, cls: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, na, nb, shared): pairs of classes within the length bound and how many of these shingles they share.

    A pair may come several times; its numbers are then summed up.
    """
    o = np.argsort(gram, kind="stable")
    g = gram[o]
    names, first, at = np.unique(cls[o], return_index=True, return_inverse=True)
    size = n[o][first]
    found, held = [], 0

    def flush() -> tuple[np.ndarray, ...]:
        nonlocal held
        key, shared = np.unique(np.concatenate(found), return_counts=True)
        found.clear()
        held = 0
        i, j = key // len(names), key % len(names)
        return names[i], names[j], size[i], size[j], shared

    for i, j in pairs_within(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)):
        x, y = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
        ok = (x != y) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent)
        found.append(x[ok] * len(names) + y[ok])
        held += len(found[-1])
        if held > PAIRS:
            yield flush()
    if held:
        yield flush()


def _blocks(docs: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """Edges (a, b) of classes that may link or are chained; every pair that links is connected by them."""
    most = _few(rarity.value)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, class, length) of prefixes, (shingle, class, merged lengths) of chains, (class, class, _EDGE)."""
        counts, cache, seen = rarity.value, {}, set()
        grams, classes, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            k = np.array(list(map(len, grams)))
            n = np.repeat(np.array(sizes, np.int64), k)
            g, c = np.concatenate(grams), np.repeat(np.array(classes, np.int64), k)
            few = _split_few(g, np.zeros(len(g)), most)
            for at in range(0, len(g), 200_000):
                on = few[at : at + 200_000]
                yield _meeting(g[at : at + 200_000][on], c[at : at + 200_000][on], n[at : at + 200_000][on])
            rows, a, b = _chains(g[~few], c[~few], n[~few], n[~few], percent)
            yield _meeting(rows[0], rows[1], rows[2] | rows[3] << 31 | _MERGED)
            a, b = _edges(a, b)
            yield _meeting(a, b, np.full(len(a), _EDGE))
            held = 0
            for x in (grams, classes, sizes):
                x.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                for s in _sets(binary_column(whole.slice(at, 500), "text"), width, cache):
                    if not len(s) or (c := _class(s)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    p = _ordered(s, counts)[: prefix_length(len(s), percent)]
                    grams.append(p)
                    classes.append(c)
                    sizes.append(len(s))
                    held += len(p)
                    if held > FLUSH:
                        yield from flush()
        if held:
            yield from flush()

    def meet(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, meta = (t.column(c).to_numpy() for c in ("a", "b", "meta"))
        edge = meta == _EDGE
        p, q = a[edge], b[edge]
        g, c, meta = a[~edge], b[~edge], meta[~edge]
        merged = meta >= _MERGED
        low = meta & (1 << 31) - 1
        high = np.where(merged, (meta ^ _MERGED) >> 31, meta)
        few = _split_few(g, merged, most)
        _, x, y = _chains(g[~few], c[~few], low[~few], high[~few], percent)
        p, q = _edges(np.concatenate([p, x]), np.concatenate([q, y]))
        chained = p, q, np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.full(len(p), 1 << 40)
        for out in (*(_counted(g[few], c[few], low[few], percent) if few.any() else ()), chained):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v).astype(np.int64)) for v in out], names=["a", "b", "na", "nb", "shared"])

    met = in_groups(docs.mapInArrow(emit, "a long, b long, meta long"), ["a"], meet, "a long, b long, na long, nb long, shared long", 200_000)
    behind = lambda n: f"({percent} * {n} + 99) div 100 - 1"
    least = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent} - greatest({behind('na')}, {behind('nb')})")
    return met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared")).where(F.col("shared") >= least).select("a", "b")


def _compare(t: pa.Table, first: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Verified edges inside each tile or tile pair, as a spanning forest over the components that are there already."""
    ends = np.append(first, t.num_rows)
    comp = t.column("comp").to_numpy()
    cls, own, cross = t.column("class").to_numpy(), t.column("own").to_numpy(), t.column("ta").to_numpy() != t.column("tb").to_numpy()
    data = t.column("data")
    out_a, out_b = [], []
    for lo, hi in zip(ends, ends[1:], strict=False):
        _, keep = np.unique(cls[lo:hi], return_index=True)  # a class may be read from several equal documents
        if len(keep) < 2:
            continue
        c, side, old = cls[lo:hi][keep], own[lo:hi][keep], comp[lo:hi][keep]
        _, head, old = np.unique(old, return_index=True, return_inverse=True)
        if len(head) < 2:
            continue
        sets = [np.frombuffer(data[int(lo + i)].as_py(), np.uint64) for i in keep]
        n = np.array(list(map(len, sets)))
        k = [prefix_length(x, percent) for x in n]
        grams = np.concatenate([s[:p] for s, p in zip(sets, k, strict=True)])
        doc, pos = np.repeat(np.arange(len(sets)), k), np.concatenate([np.arange(p) for p in k])
        o = np.argsort(grams, kind="stable")
        grams, doc, pos = grams[o], doc[o], pos[o]
        start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        found = []
        for i, j in pairs_within(start, len(grams)):
            if cross[lo]:
                ok = side[doc[i]] != side[doc[j]]
                i, j = i[ok], j[ok]
            x, y = doc[i], doc[j]
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (small * 100 >= large * percent) & (old[x] != old[y])
            found.append(np.stack([x[ok] * len(sets) + y[ok], pos[i][ok], pos[j][ok]], 1))
        if not found:
            continue
        f = np.concatenate(found)
        f = f[np.lexsort((f[:, 1], f[:, 0]))]
        f = f[np.append(True, f[1:, 0] != f[:-1, 0])] if len(f) else f  # at the first shared shingle
        x, y = f[:, 0] // len(sets), f[:, 0] % len(sets)
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        ok = 1 + np.minimum(n[x] - f[:, 1], n[y] - f[:, 2]) - 1 >= need
        x, y, need = x[ok], y[ok], need[ok]
        sketch = np.stack([np.packbits((np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)) for s in sets])
        differ = np.concatenate([np.bitwise_count(sketch[x[a : a + 50_000]] ^ sketch[y[a : a + 50_000]]).sum(1, dtype=np.int64) for a in range(0, len(x), 50_000)] or [np.zeros(0, np.int64)])
        ok = differ <= n[x] + n[y] - 2 * need
        x, y, need, differ = x[ok], y[ok], need[ok], differ[ok]
        root = head[old].tolist()

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        ready: dict[int, np.ndarray] = {}
        for at in np.argsort(differ, kind="stable"):
            i, j = int(x[at]), int(y[at])
            p, q = find(i), find(j)
            if p == q:
                continue
            for z in (i, j):
                if z not in ready:
                    ready[z] = np.sort(sets[z])
            both = len(np.intersect1d(ready[i], ready[j], assume_unique=True))
            if both * 100 >= (n[i] + n[j] - both) * percent:
                root[max(p, q)] = min(p, q)
                out_a.append(c[i])
                out_b.append(c[j])
    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _tiles(classes: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.sum(classes) / TILE), F.ceil(F.sum(shingles) / TILE_SHINGLES)).cast("int")


def _alone(members: DataFrame) -> DataFrame:
    """class, read, block, own, others, comp: each class in its tile only, and pivots in all tiles of their block."""
    tiles = members.groupBy(F.col("block").alias("bl")).agg(_tiles("one", "n").alias("tiles"))
    pivot = F.pmod(F.xxhash64("class", F.lit(1)), F.col("tiles") * F.lit(max(1, TILE // PIVOTS))) == 0
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    everywhere = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own)))
    return members.join(tiles, F.col("block") == F.col("bl")).select("class", "read", "block", everywhere.alias("own")).select("*", F.array("own").alias("others"), F.col("class").alias("comp"))


def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The same for blocks of several tiles that are not one component yet: components of a tile or more have tiles of their
    own, which need not be compared with each other; all other classes of the block share tiles."""
    large = members.groupBy(F.col("block").alias("bl")).agg(_tiles("one", "n").alias("tiles")).where("tiles > 1").select("bl")
    held = members.join(large, F.col("block") == F.col("bl")).join(joined, F.col("class") == F.col("node"), "left")
    held = held.select("class", "read", "n", "block", F.coalesce("component", "class").alias("comp"))
    parts = held.groupBy("block", "comp").agg(F.count("*").alias("one"), F.sum("n").alias("n"))
    # 0 stands for the shared tiles; a component of that name, were there one, would be compared with itself for nothing
    parts = parts.withColumn("part", F.when((F.col("one") >= TILE) | (F.col("n") >= TILE_SHINGLES), F.col("comp")).otherwise(F.lit(0)))
    kinds = parts.groupBy("block", "part").agg(_tiles("one", "n").alias("tiles"), F.count("*").alias("comps"))
    block = Window.partitionBy("block")
    before = F.sum("tiles").over(block.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.select("block", "part", "tiles", F.coalesce(before, F.lit(0)).cast("int").alias("start"), F.sum("tiles").over(block).cast("int").alias("all"), F.sum("comps").over(block).alias("comps"))
    kinds = kinds.where("comps > 1").select(F.col("block").alias("kb"), F.col("part").alias("kp"), "tiles", "start", "all")
    where = parts.select(F.col("block").alias("pb"), F.col("comp").alias("pc"), "part").join(kinds, (F.col("pb") == F.col("kb")) & (F.col("part") == F.col("kp")))
    placed = held.join(where, (F.col("block") == F.col("pb")) & (F.col("comp") == F.col("pc")))
    own = F.col("start") + F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: (F.col("part") == 0) | (x < F.col("start")) | (x >= F.col("start") + F.col("tiles")))
    return placed.select("class", "read", "block", own.alias("own"), others.alias("others"), "comp")


def groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, component of every document.

    Two documents link when percent of their union is shared; components are named by their smallest doc_id.
    component tells components apart whose documents share ids (null without words).
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    survey = cut(_survey(rows, width))
    rarity = spark.sparkContext.broadcast(_rarity(survey))
    slim = survey.where("data is null").select("row_key", "doc_id", "class", "n")
    meetings = cut(_blocks(rows.select("text"), rarity, width, percent))
    release(spark)
    block = components(meetings)
    reads = slim.where("class is not null").groupBy("class").agg(F.min("row_key").alias("read"), F.first("n").alias("n"))
    members = cut(block.join(reads, F.col("node") == F.col("class")).select("class", "read", "n", F.col("component").alias("block"), F.lit(1).alias("one")))
    release(spark)

    def tiled(placed: DataFrame) -> DataFrame:
        """(block, ta, tb, class, own, comp, data): the set of each class in the pairs of its tile `own` with those in `others`."""
        wanted = spark.sparkContext.broadcast(bitmap_of(placed, "read", MAP_BITS))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, cache = rarity.value, {}
            for whole in batches:
                w = whole.filter(pa.array(has_bit(wanted.value, whole.column("row_key").to_numpy(), MAP_BITS)))
                for at in range(0, w.num_rows, 200):
                    b = w.slice(at, 200)
                    cls, key, data = [], [], []
                    for k, s in zip(b.column("row_key").to_pylist(), _sets(binary_column(b, "text"), width, cache), strict=True):
                        if len(s):
                            cls.append(_class(s))
                            key.append(k)
                            data.append(_ordered(s, counts).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=["c", "k", "data"])

        sets = rows.select("row_key", "text").mapInArrow(fetch, "c long, k long, data binary")
        held = sets.join(placed, (F.col("c") == F.col("class")) & (F.col("k") == F.col("read")))
        return held.select("block", "class", "own", "comp", "data", F.explode("others").alias("other")).select(
            "block", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "class", "own", "comp", "data"
        )

    def compared(placed: DataFrame) -> DataFrame:
        return cut(in_groups(tiled(placed), ["block", "ta", "tb"], lambda t, first: _compare(t, first, percent), "a long, b long", 2_000))

    links = compared(_alone(members))
    joined = components(links)
    apart = cut(_apart(members, joined))
    if not apart.isEmpty():
        joined = components(links.union(compared(apart)))
    named = slim.join(joined, F.col("class") == F.col("node"), "left").select("row_key", "doc_id", "n", F.coalesce("component", "class").alias("comp"))
    named = cut(named)
    least = named.where("comp is not null").groupBy(F.col("comp").alias("g")).agg(F.min("doc_id").alias("least"))
    return named.join(least, F.col("comp") == F.col("g"), "left").select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.col("comp").alias("component")
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (null last), then of the smallest row_key; all columns stay.

    Rows with the kept doc_id and text are copies of one document: of them the one with the smallest hash of all its
    columns stays. They are summed up before they meet, so a row may be a third of the table. Only rows that
    go or are copies, and a few that a bit filter takes for such, are sent; the others pass from the scan.
    """
    spark = docs.sparkSession
    release(spark)
    text = F.col("text").cast("string")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    g = groups(docs, width, percent)
    winners = g.groupBy(F.coalesce("component", "row_key").alias("c"), F.col("component").isNull()).agg(first.alias("_g_key"))
    counted = g.groupBy(F.col("row_key").alias("w_key")).agg(F.count("*").alias("same"))
    judged = counted.join(winners, F.col("w_key") == F.col("_g_key"), "left").select("w_key", "same", F.col("_g_key").isNotNull().alias("stays"))
    doubtful = cut(judged.where("same > 1 or not stays").select("w_key", "stays"))
    release(spark)
    in_doubt = bit_test(doubtful, "w_key")
    held = docs.select(F.struct("*").alias("r"), F.xxhash64("doc_id", text).alias("k"), row_key(docs).alias("whole"))
    sent = held.where(in_doubt(F.col("k"))).groupBy("k").agg(F.min_by("r", "whole").alias("r")).join(doubtful, F.col("k") == F.col("w_key"), "left")
    kept = held.where(~in_doubt(F.col("k"))).select("r").unionAll(sent.where("w_key is null or stays").select("r"))
    return kept.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
