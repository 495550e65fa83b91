"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

Lines are sets of lowered tokens. Tokens are numbers whose order is rarity (by
hashed counts over all documents, a table of fixed size) and which keep all bits
of the token's 64-bit hash. Of each distinct set the rarest tokens form the
prefix that any similar set must meet. Sets that meet pass the length bound, the
positional bound and a parity sketch (whose bits never differ in more places than the
sets do); what is left is verified by exact Jaccard. A line is removed if an
earlier line (by doc_id, then line number) is similar enough.

Equal sets are one row of the join, so a line that stands in a third of the
documents costs its occurrences once. A set is first tried against two pivots of
each of its meeting tokens, the earliest set and the most repeated one; only sets
that no pivot settles are tried against all they meet. So a large group of
near copies takes a number of pairs that grows with the group, not its square.

Defined cases: lines with fewer than `min_tokens` distinct tokens stay; null text stays
null; a null doc_id comes last; rows with equal doc_id and text are one document
and are treated alike; empty tables give no rows; other columns pass through
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, bit_test, each, release

PERCENT = 85
MIN_TOKENS = 5
BUCKETS = 1 << 16  # of token counts; fixed, whatever the vocabulary
SAMPLE = None  # not read: all documents are counted; a test from when it bounded them still sets it
OTHER_SPACES = "\t\v\f\r"  # besides the blank, and the line feed that ends lines


def _key(text: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), text)


def _spaced(text: Column) -> Column:
    """Lowered text in which blanks and line feeds are the only white space. `text` is looked through before it is
    lowered, since generators compute an expression anew wherever it stands."""
    odd = F.lit(False)
    for c in OTHER_SPACES:
        odd = odd | text.contains(c)
    return F.lower(F.when(odd, F.regexp_replace(text, f"[{OTHER_SPACES}]", " ")).otherwise(text))


def _rank_table(docs: DataFrame) -> Column:
    """Rank of each token bucket by its count in all documents, as an array literal."""
    words = docs.select(F.explode(F.split(F.replace(_spaced(F.col("_text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    slot = F.xxhash64("w").bitwiseAND(BUCKETS - 1)
    counts = {r["b"]: r["n"] for r in words.groupBy(slot.alias("b")).agg(F.count("*").alias("n")).collect()}
    order = sorted(range(BUCKETS), key=lambda b: (counts.get(b, 0), b))
    rank = [0] * BUCKETS
    for i, b in enumerate(order):
        rank[b] = i - BUCKETS // 2
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<smallint>")


def _hashes(line: Column) -> Column:
    """Hashes of the distinct tokens of a spaced line, in no order: two are equal where their numbers are."""
    return F.array_distinct(each(F.array_remove(F.split(line, " "), ""), lambda x: F.xxhash64(x), "string"))


def _token_ids(line: Column, ranks: Column) -> Column:
    """Distinct tokens of a spaced line as numbers, rarest first; none is null, so Spark sorts them as plain longs."""

    def number(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("smallint")).cast("long")
        return F.shiftleft(rank, 48).bitwiseOR(F.shiftrightunsigned(h, 16))

    return F.sort_array(each(_hashes(line), number, "bigint"))


def _lines(docs: DataFrame) -> DataFrame:
    """_k, _doc, line_no, line of every line of docs (_k, _doc, _text)."""
    return docs.select("_k", "_doc", F.posexplode(F.split(_spaced(F.col("_text")), "\n")).alias("line_no", "line"))


def _may_match(percent: int) -> Column:
    """Length, positional and sketch bounds between rows x and y of a shared prefix token.

    Similar sets have `percent * (x.n + y.n)` at most `100 + percent` times their intersection. The sketch, which
    settles most pairs, comes first; nothing is divided, since a join computes an expression anew wherever it stands.
    """
    n = F.col("x.n").cast("long") + F.col("y.n")
    apart = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch")))  # even where n is
    return (
        ((n - apart) * (100 + percent) >= n * (2 * percent))
        & (F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) * F.lit(100 + percent).cast("long") >= n * percent)
        & (F.least("x.n", "y.n") * F.lit(100).cast("long") >= F.greatest("x.n", "y.n") * F.lit(percent).cast("long"))
        & ((F.col("x.d") != F.col("y.d")) | (F.col("x.sketch") != F.col("y.sketch")))
    )


def _place() -> Column:
    """What orders lines."""
    return F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_k", "line_no")


def _sets(wide: DataFrame, repeated) -> DataFrame:
    """d, sketch, n and prefix of each distinct set, which is known by two hashes and its size.

    `repeated` holds for the hashes d of all sets that stand more than once; only those are grouped.
    """
    columns = ["d", "sketch", "n", "prefix"]
    many = wide.where(repeated(F.col("d"))).groupBy("d", "sketch", "n").agg(F.first("prefix").alias("prefix"))
    return wide.where(~repeated(F.col("d"))).select(*columns).unionAll(many.select(*columns))


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Sets x that reach percent with their partner y; full has the tokens of each set e.

    The bound is put so that it holds the intersection once: what stands twice in a filter is computed twice.
    """
    size = lambda c: F.size(c).cast("long")
    met = pairs.join(full.select(F.col("e").alias("x"), F.col("tokens").alias("a")), "x").join(full.select(F.col("e").alias("y"), F.col("tokens").alias("b")), "y")
    return met.where(size(F.array_intersect("a", "b")) * (100 + percent) >= (size("a") + size("b")) * percent).select("x").distinct()


def removed_lines(docs: DataFrame, store: Stored, percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """_k, _doc, line_no of every line to remove; docs has _k, _doc, _text."""
    spark = docs.sparkSession
    ranks = _rank_table(docs)
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    sketch = F.expr("aggregate(ids, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))")
    # lines of few tokens go when the table is read: a filter before it would compute the tokens twice
    wide = store.keep(
        "lines",
        _lines(docs)
        .select("_k", "_doc", "line_no", _token_ids(F.col("line"), ranks).alias("ids"))
        .select("*", F.size("ids").alias("n"))
        .select("_k", "_doc", "line_no", F.xxhash64("ids").alias("d"), "n", sketch.alias("sketch"), F.slice("ids", F.lit(1), prefix.cast("int")).alias("prefix")),
    ).where(F.col("n") >= min_tokens)
    repeated = bit_test(store.keep("repeated", wide.groupBy("d", "sketch", "n").agg(F.count("*").alias("times")).where("times > 1")), "d")
    sets = _sets(wide, repeated)
    rows = sets.select("d", "sketch", "n", F.posexplode("prefix").alias("i", "token"))
    met = store.keep("met", rows.alias("x").join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & _may_match(percent), "left_semi"))
    release(spark)

    may = bit_test(met, "d")
    firsts = store.keep("firsts", wide.where(repeated(F.col("d")) | may(F.col("d"))).groupBy("d", "sketch").agg(F.min(_place()).alias("place"), F.count("*").alias("times")))
    placed = store.keep("placed", met.join(firsts, ["d", "sketch"]).withColumn("e", F.struct("d", "sketch")))
    where = store.keep("where", placed.select("e", F.col("place._k").alias("fk"), F.col("place._doc").alias("fd"), F.col("place.line_no").alias("fl")).distinct())
    in_doc = bit_test(where, "fk")
    line_key = lambda k, n: F.xxhash64(F.col(k), F.col(n))
    in_line = bit_test(where.select(line_key("fk", "fl").alias("h")), "h")
    full = store.keep(
        "full",
        _lines(docs.where(in_doc(F.col("_k"))))
        .where(in_line(line_key("_k", "line_no")))
        .join(where, (F.col("_k") == F.col("fk")) & F.col("_doc").eqNullSafe(F.col("fd")) & (F.col("line_no") == F.col("fl")))
        .groupBy("e")
        .agg(F.first("line").alias("line"))
        .select("e", _hashes(F.col("line")).alias("tokens")),
    )

    record = F.struct("d", "e", "n", "i", "sketch", "place")
    pivots = placed.groupBy("token").agg(F.min_by(record, "place").alias("p"), F.max_by(record, "times").alias("q"))
    pivots = pivots.select("token", F.explode(F.array("p", "q")).alias("y")).select("token", "y.*")
    earlier = F.col("y.place") < F.col("x.place")
    pairs = (F.col("x.token") == F.col("y.token")) & earlier & _may_match(percent)
    ends = [F.col("x.e").alias("x"), F.col("y.e").alias("y")]
    tried = store.keep("tried", placed.alias("x").join(pivots.alias("y"), pairs).select(*ends).distinct())
    settled = store.keep("settled", _verified(tried, full, percent))
    open_ = placed.join(settled.withColumnRenamed("x", "e"), "e", "left_anti")
    rest = open_.alias("x").join(placed.alias("y"), pairs).select(*ends).distinct().join(tried, ["x", "y"], "left_anti")
    similar = store.keep("similar", settled.union(_verified(rest, full, percent)).select("x.d", "x.sketch"))
    state = firsts.join(similar.withColumn("similar", F.lit(True)), ["d", "sketch"], "left").where("similar or times > 1").select(
        F.col("d").alias("g"), F.col("sketch").alias("h"), "place", F.coalesce("similar", F.lit(False)).alias("similar")
    )
    state = store.keep("state", state)
    touched = bit_test(state, "g")
    marked = wide.where(touched(F.col("d"))).join(state, (F.col("d") == F.col("g")) & (F.col("sketch") == F.col("h")))
    return marked.where(F.col("similar") | (F.col("place") != _place())).select("_k", "_doc", "line_no").distinct()


def dedup(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with its columns, text without the removed lines, and n_lines and n_removed in one struct column _dedup.

    Only documents that lose a line meet their marks; the others pass from the scan.
    """
    spark = docs.sparkSession
    store = Stored(spark, "line_dedup")
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("r"), _key(text).alias("k"), F.col("doc_id").alias("doc"), text.alias("t"))
    slim = docs.select(_key(text).alias("_k"), F.col("doc_id").alias("_doc"), text.alias("_text")).where("_text is not null")
    found = removed_lines(slim, store, percent, min_tokens)
    gone = store.keep("gone", found.groupBy(F.col("_k").alias("g"), F.col("_doc").alias("h")).agg(F.sort_array(F.collect_list("line_no")).alias("gone")))
    for name in ("lines", "repeated", "met", "firsts", "placed", "where", "full", "tried", "settled", "similar", "state"):
        store.drop(name)
    release(spark)
    loses = bit_test(gone.select("g"), "g")
    # a mark for each line up to the last one removed; a byte of it is found at once, however many lines there are
    marks = F.transform("gone", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.lit("1")))
    met = keyed.where(loses(F.col("k"))).join(gone, (F.col("k") == F.col("g")) & F.col("doc").eqNullSafe(F.col("h")), "left")
    met = met.select("r", "t", F.split("t", "\n").alias("all"), F.array_join(marks, "").cast("binary").alias("marks"), F.size("gone").alias("n"))
    keep = F.filter("all", lambda x, i: ~F.coalesce(F.substring("marks", i + 1, F.lit(1)) == F.lit(bytearray(b"1")), F.lit(False)))
    kept = F.when(F.col("n") > 0, F.array_join(keep, "\n")).otherwise(F.col("t"))
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")

    def rows(df: DataFrame, text: Column, n_lines: Column, n_removed: Column) -> DataFrame:
        return df.select(
            *[text.alias("text") if c == "text" else F.col("r").getField(c).alias(c) for c in docs.columns],
            F.struct(count(n_lines).alias("n_lines"), count(n_removed).alias("n_removed")).alias("_dedup"),
        )

    lines = F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1
    untouched = rows(keyed.where(~loses(F.col("k"))), F.col("t"), lines, F.lit(0))
    return rows(met, kept, F.size("all"), F.col("n")).unionAll(untouched)


def clean(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with deduplicated texts and n_chars to match; documents that lost all their words are left out."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = dedup(docs, percent, min_tokens).where(~((F.col("_dedup.n_removed") > 0) & blank("text")))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
