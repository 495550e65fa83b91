"""BM25 over a whole query tree, with stems and expansions.

Every text leaf becomes one or more children. A child has a weighted frequency over all
text fields of a row, and counts only where the leaf's own field holds its term. And
and or both add; not, tags, numbers and places add nothing; a bare `*` ranks by length.
Children of known terms are columns and their statistics one pre-aggregated row, so no
posting is shuffled; children of wildcards and fuzzy words are joined by term.

Rows whose key is null match but are not ranked with one another: each gets the scores of its own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem, with_stem
from .search import Field, Schema, compile_query, indexed, is_pattern, parse, term_test

K1, B = 1.2, 0.75


def _weight(f: Field) -> int:
    return max(1, int(f.weight))


def _stem_weight(f: Field) -> int:
    return max(1, int(f.weight * 0.2))


def _leaves(ast) -> list[tuple]:
    if ast[0] in ("and", "or"):
        return [leaf for x in ast[1:] for leaf in _leaves(x)]
    return [ast] if ast[0] in ("text", "phrase") else []


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


class _Ranker:
    def __init__(self, schema: Schema):
        self.schema, self.children = schema, []

    def _of(self, f: Field) -> Column:
        return F.col(f"_t_{f.name}")

    def _counted(self, owner: str | None, fields: list[Field], count: Callable[[Field], Column], weight: Callable[[Field], int]) -> None:
        """One child: its frequency, and whether the leaf's own field has it."""
        there = F.lit(True) if owner is None else _total([count(f) for f in fields if f.name == owner]) > 0
        self.children.append((_total([count(f) * weight(f) for f in fields]), there))

    def surface(self, word: str, owner: str | None) -> None:
        self._counted(owner, self.schema.texts, lambda f: F.size(F.filter(self._of(f), lambda x: x == word)), _weight)

    def expanded(self, word: str, owner: str | None) -> None:
        self.surface(word, owner)
        stemmed = [f for f in self.schema.texts if f.stem]
        if not stemmed:
            return
        base = stem(word, self.schema.language)
        other = lambda f: F.filter(self._of(f), lambda x: x != base)
        self._counted(owner, stemmed, lambda f: F.size(F.filter(with_stem(other(f), base, self.schema.language), lambda x: x == base)), _stem_weight)
        if base != word:
            self.surface(base, owner)


def _found(f: Field, test: Callable[[Column], Column], owner: str | None) -> Column:
    """Tokens of the field that pass, with its weight and whether the leaf asks for this field."""
    weight, own = F.lit(_weight(f)).alias("w"), F.lit(owner in (None, f.name)).alias("own")
    return F.transform(F.filter(F.col(f"_t_{f.name}"), test), lambda x: F.struct(x.alias("t"), weight, own))


def ranked(df: DataFrame, query: str, schema: Schema, key: str) -> DataFrame:
    """(key, score) of the rows that the query matches; key must be unique."""
    ast = parse(query)
    ranker = _Ranker(schema)
    patterns = []
    for kind, owner, value in _leaves(ast):
        if owner is not None:
            schema.field(owner, "TEXT")
        if kind == "phrase":
            for w in re.findall(r"\w+", value.lower()):
                if w not in schema.stop:
                    ranker.surface(w, owner)
        elif is_pattern(value):
            patterns.append((value, owner))
        elif value.lower() not in schema.stop:
            ranker.expanded(value.lower(), owner)

    def words(f: Field) -> Column:
        return F.coalesce(indexed(f, schema), F.array().cast("array<string>"))

    base = df.select(F.col(key), compile_query(ast, schema).alias("_hit"), *[words(f).alias(f"_t_{f.name}") for f in schema.texts])
    length = _total([F.size(f"_t_{f.name}") * _weight(f) for f in schema.texts])
    n = len(ranker.children)
    per = base.select(
        key, "_hit", length.alias("_dl"),
        *[tf.alias(f"_tf{i}") for i, (tf, _) in enumerate(ranker.children)],
        *[there.alias(f"_on{i}") for i, (_, there) in enumerate(ranker.children)],
    )
    stats = per.agg(
        F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(n)]
    )
    stats = stats.withColumn("_avg", F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(F.lit(1.0))).withColumn("_one", F.lit(1))
    norm = K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))

    def score(tf: Column, rows: Column) -> Column:
        idf = F.log(1 + (F.col("_n") - rows + 0.5) / (rows + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0))

    # the statistics are one row
    both = per.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    if ast == ("all",):
        return both.select(key, ((K1 + 1) / (1 + norm)).alias("score"))
    known = _total([F.when(F.col(f"_on{i}"), score(F.col(f"_tf{i}"), F.col(f"_df{i}"))).otherwise(F.lit(0.0)) for i in range(n)])
    out = both.where("_hit").select(key, known.cast("double").alias("score"), "_n", norm.alias("_norm"))
    for j, (value, owner) in enumerate(patterns):
        found = [_found(f, term_test(value, f.bytewise), owner) for f in schema.texts]
        rows = base.select(key, F.explode(F.concat(*found)).alias("x")).groupBy(key, F.col("x.t").alias("_t")).agg(F.sum("x.w").alias("_f"), F.bool_or("x.own").alias("_own"))
        rows = rows.join(rows.groupBy("_t").agg(F.count("*").alias("_rows")), "_t").where("_own")
        idf = F.log(1 + (F.col("_n") - F.col("_rows") + 0.5) / (F.col("_rows") + 0.5))
        best = out.join(rows, key).select(key, (idf * F.col("_f") * (K1 + 1) / (F.col("_f") + F.col("_norm"))).alias("_s")).groupBy(key).agg(F.max("_s").alias(f"_s{j}"))
        out = out.join(best, key, "left").withColumn("score", F.col("score") + F.coalesce(f"_s{j}", F.lit(0.0))).drop(f"_s{j}")
    return out.select(key, "score")
