"""Mixing sources to target weights by distributed prefix sums.

Every source has a word budget. Whole epochs of the source are taken while they
fit; for the rest, documents are ordered by a random hash key and taken up to
the word at which the budget is met. The order within a source is cut into key
ranges of about equal counts; the ranges' sums give each range its offset, and
a running sum inside each range completes the prefix sums, so a source that
holds most rows is spread over many tasks.

Defined cases: null text has no words; a null source is a source of its own
and comes last; documents without words are taken in the epochs that their
place in the order falls in, at no cost; ties of the key are ordered by doc_id
and size; fully repeated rows are taken one after the other, rows that differ in
any column (as source or lang) are rows of their own; an empty table gives no rows; columns besides doc_id, text and source are ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_key

KEY_BITS = 40


def _code_points(c: str) -> list[Column]:
    """Order by code point with null last."""
    return [F.col(c).isNull(), F.col(c)]


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target from one row per source.

    Weights repeat over the sources in code-point order. The targets share the
    total of all sizes by weight; a target above `most` times its source's size
    stops there and the excess is shared again. The fixed point of that is a
    water level: with sources in order of cap per weight, the first k stop at
    their caps and the others get level * weight, so two running sums suffice.
    """
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    a = sizes.select("*", F.row_number().over(Window.orderBy(*_code_points("source"))).alias("n")).select(
        "source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap")
    )
    order = Window.orderBy(F.col("cap") / F.col("w"), *_code_points("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    b = a.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    ).select("*", ((F.col("total") - F.col("capped")) / F.col("w_left")).alias("level"))
    # the level is that of the first source that does not stop
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))
    c = b.select("*", F.min(free).over(whole)["level"].alias("final"))
    return c.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap")).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: int = 17, range_rows: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, row_key of each row.

    taken is the number of words that the mix takes of the row, repeats
    counted; its sum over a source is the target rounded down. range_rows: rows
    in a key range, by default so many that there are eight ranges a task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col("doc_id"), text).alias("text_key"),
            row_key(docs).alias("row_key"),
        )
    )
    key = F.shiftrightunsigned(F.xxhash64(F.col("text_key"), F.lit(seed)), 64 - KEY_BITS)
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(per_source.select("source", "source_size"), weights, most)
    total = per_source.agg(F.sum("rows")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = range_rows or max(1, total // (8 * tasks))
    ranges = F.greatest(F.lit(1), F.floor(F.col("rows") / rows)).cast("long")
    place = F.shiftright(F.col("key") * F.col("ranges"), KEY_BITS)
    info = cut(goal.join(per_source.select(F.col("source").alias("s"), ranges.alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    keyed = slim.select("*", key.alias("key")).join(F.broadcast(info.withColumnRenamed("source", "s")) if _few(info) else info.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    keyed = keyed.select("*", place.alias("range")).drop("s", "ranges")
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("inside"))
    ahead = sums.select(
        F.col("source").alias("s"), F.col("range").alias("r"),
        (F.sum("inside").over(Window.partitionBy("source").orderBy("range")) - F.col("inside")).alias("ahead"),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("run"))
    placed = running.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(1))
    rest = budget - F.col("epochs") * F.col("source_size")
    start = F.col("ahead") + F.col("run")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (
        placed.select("doc_id", "source", "size", "source_size", "target", "row_key", start.alias("start"), epochs.alias("epochs"))
        .select("*", rest.alias("rest"))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + partial).cast("long").alias("taken"),
            "row_key",
            F.when(F.col("size") > 0, F.floor((F.col("epochs") * F.col("size") + partial) / F.col("size") + 0.5))
            .otherwise(F.col("epochs") + (F.col("start") < F.col("rest")).cast("long")).cast("int").alias("copies"),
        )
    )


#: A source table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _few(info: DataFrame) -> bool:
    return info.count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus with the columns of docs: each row as often as the plan
    takes it, the row at the budget's end rounded to all or none, so texts stay whole.

    Rows that are equal in all columns are summed into one before it is repeated,
    so a row that makes up a third of the table meets its plan once.
    """
    chosen = plan(docs, weights, most, seed).groupBy(F.col("row_key").alias("_row")).agg(F.sum("copies").alias("copies"), F.count("*").alias("_same")).where("copies > 0")
    held = docs.select(F.struct("*").alias("r"), row_key(docs).alias("k")).join(chosen, F.col("k") == F.col("_row"))
    single = held.where("_same = 1").select("r", "copies")
    repeated = held.where("_same > 1").groupBy("k").agg(F.first("r").alias("r"), F.first("copies").alias("copies")).select("r", "copies")
    counted = single.unionAll(repeated)
    return counted.select("r", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("i")).select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
