"""Named search indexes over tables, their aliases, term dictionaries, synonyms and suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import nearest, ranking, search


@dataclass
class Index:
    table: DataFrame
    schema: search.Schema
    key: str


@dataclass
class Catalog:
    """Definitions only; every query is planned over the index's table when it is asked."""

    indexes: dict[str, Index] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def create(self, name: str, table: DataFrame, key: str, *fields: search.Field, stop_words: list[str] | None = None, language: str = "english") -> None:
        if name in self.indexes or name in self.aliases:
            raise ValueError(f"index exists: {name}")
        self.indexes[name] = Index(table, search.Schema(*fields, stop_words=stop_words, language=language), key)

    def alter(self, name: str, new: search.Field) -> None:
        i = self.get(name)
        i.schema = search.Schema(*i.schema.fields.values(), new, stop_words=list(i.schema.stop), language=i.schema.language)

    def drop(self, name: str) -> None:
        self.indexes.pop(name)
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}

    def alias(self, alias: str, name: str, update: bool = False) -> None:
        if alias in self.indexes or (alias in self.aliases and not update) or name not in self.indexes:
            raise ValueError(alias)
        self.aliases[alias] = name

    def remove_alias(self, alias: str) -> None:
        self.aliases.pop(alias)

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def get(self, name: str) -> Index:
        return self.indexes[self.aliases.get(name, name)]

    def search(
        self, name: str, query: str, sort: str | None = None, descending: bool = False, offset: int = 0, count: int = 10,
        returns: list[str] | None = None, slop: int | None = None, in_order: bool = False, params: dict[str, list[float]] | None = None,
    ) -> DataFrame:
        """A page of matching rows: by the sort field (missing last), ties and otherwise by key.

        slop and in_order also ask that the query's words stand near each other in one text field; a vector query takes its
        vectors from params and ranks by distance unless a sort field is named. returns chooses columns.
        """
        i = self.get(name)
        if nearest.is_vector_query(query):
            hits = nearest.nearest(i.table, query, i.schema, i.key, params or {})
            score = hits.columns[-1]
            order = [F.col(score), F.col(i.key)]
        else:
            score, hits, order = None, search.search(i.table, query, i.schema), [F.col(i.key)]
        words = search.plain_words(search.parse(query), i.schema) if score is None and (slop is not None or in_order) else []
        if len(words) > 1:
            most = (1 << 30) if slop is None else slop
            hits = hits.where(reduce(lambda x, y: x | y, [is_near(search.indexed(f, i.schema), words, most, in_order) for f in i.schema.texts]))
        if sort:
            c = F.col(score) if sort == score else i.schema.field(sort).col
            order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(i.key)]
        out = hits.orderBy(*order)
        out = (out.offset(offset) if offset else out).limit(count)
        return out.select(*returns) if returns else out

    def ranked(self, name: str, query: str, offset: int = 0, count: int = 10) -> DataFrame:
        """A page of (key, score), best first, ties by key."""
        i = self.get(name)
        out = ranking.ranked(i.table, query, i.schema, i.key).orderBy(F.desc("score"), i.key)
        return (out.offset(offset) if offset else out).limit(count)

    def aggregate(self, name: str, query: str, *args: str) -> DataFrame:
        i = self.get(name)
        return search.aggregate(i.table, i.schema, query, *args)

    def info(self, name: str) -> DataFrame:
        i = self.get(name)
        fields = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind")) for f in i.schema.fields.values()])
        return i.table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("index"), "rows", fields.alias("fields"))


def synonyms(groups: DataFrame) -> DataFrame:
    """(term, groups) of (grp, term): a term's groups in order."""
    return groups.groupBy(F.lower("term").alias("term")).agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def suggestions(log: DataFrame) -> DataFrame:
    """(value, score, payload) from additions (value, score, payload, incr, seq): incr adds to the score since the last plain one."""
    plain = log.where("not incr").groupBy("value").agg(F.max("seq").alias("_from"))
    both = log.join(plain, "value", "left").where(F.col("seq") >= F.coalesce("_from", "seq"))
    return both.groupBy("value").agg(F.sum("score").alias("score"), F.max_by("payload", "seq").alias("payload"))


def suggestion_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_distinct("value").alias("entries"))


def delete_suggestions(log: DataFrame, values: DataFrame) -> DataFrame:
    """The log without the additions of the values."""
    return log.join(values.select("value").distinct(), "value", "left_anti").select(*log.columns)


def dictionary_add(words: DataFrame, new: DataFrame) -> DataFrame:
    """(dict, term) with the new ones, each once."""
    return words.select("dict", "term").unionAll(new.select("dict", "term")).where("term is not null").distinct()


def dictionary_delete(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone.select("dict", "term").distinct(), ["dict", "term"], "left_anti")


def dictionary_terms(words: DataFrame, name: str) -> DataFrame:
    """Terms of a dictionary in order."""
    return words.where(F.col("dict") == name).select("term").distinct().orderBy("term")


def _places(tokens: Column, word: str) -> Column:
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == word, i)), lambda p: p.isNotNull())


def _first_after(places: Column, place: Column) -> Column:
    return F.array_min(F.filter(places, lambda q: q > place))


def is_near(tokens: Column, words: list[str], slop: int, in_order: bool) -> Column:
    """Whether all words stand at distinct places of a span with at most slop other words between them.

    In order, each word is taken at its first place after the one before, for every place of the first. In any order,
    a window that begins at some word must hold every word as often as it is asked for.
    """
    at = {w: _places(tokens, w) for w in dict.fromkeys(words)}
    span = len(words) - 1 + slop

    def ordered(start: Column) -> Column:
        end = start
        for w in words[1:]:
            end = _first_after(at[w], end)
        return F.coalesce(end - start <= span, F.lit(False))

    def within(start: Column) -> Column:
        enough = [F.size(F.filter(at[w], lambda q: (q >= start) & (q <= start + span))) >= words.count(w) for w in at]
        return reduce(lambda x, y: x & y, enough)

    hit = F.exists(at[words[0]], ordered) if in_order else F.exists(F.flatten(F.array(*at.values())), within)
    return F.coalesce(hit, F.lit(False))


def near(df: DataFrame, text: str, words: list[str], slop: int = 0, in_order: bool = True) -> DataFrame:
    """Rows that hold all words at distinct places of a span with at most slop other words between them."""
    return df.where(is_near(tokens(text), [w.lower() for w in words], slop, in_order))
