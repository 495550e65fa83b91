"""Search over tables: a boolean query language compiled to column predicates, ranking, staged aggregation.

Query: `a b` is and, `a | b` or, `-a` not, parentheses group, `*` is every row.
`@f:{v}` tag, `@f:[1 5]` closed numeric range, `@f:[lon lat r unit]` radius, `@f:word`,
`@f:(group)`, `"a phrase"`, `pre*`, `*suf`, `*mid*`, `%fuzzy%` (one % per edit, up to three).
Plain and fuzzy words and phrases also match by stem, in the schema's language, on fields that have stems.
Predicates go to the scan with the rest of the plan; nothing is evaluated on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stemming import stem, stems, with_stem
from ..functions.text import tokens, within_edits

# The default stop words.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


@dataclass(frozen=True)
class Field:
    """kind: TAG, NUMERIC, TEXT, GEO (text "lon,lat") or VECTOR; column: where it is (default: name).

    Words of a TEXT field also match by their stems, unless stem is false; its weight counts in the ranking.
    An edit of a fuzzy word is one of a character or, if bytewise, of a UTF-8 byte, as DuckDB counts them.
    """

    name: str
    kind: str
    column: str | None = None
    weight: float = 1.0
    stem: bool = True
    bytewise: bool = False

    @property
    def col(self) -> Column:
        return F.col(self.column or self.name)


class Schema:
    def __init__(self, *fields: Field, stop_words: list[str] | None = None, language: str = "english"):
        self.fields = {f.name: f for f in fields}
        self.language = language
        self.stop = frozenset(STOP_WORDS if stop_words is None else stop_words)

    def field(self, name: str, *kinds: str) -> Field:
        f = self.fields.get(name)
        if f is None or (kinds and f.kind not in kinds):
            raise ValueError(f"no {'/'.join(kinds) or 'such'} field: {name}")
        return f

    @property
    def texts(self) -> list[Field]:
        return [f for f in self.fields.values() if f.kind == "TEXT"]


_LEX = re.compile(r'\s*(?:(@\w+):(\{[^}]*\}|\[[^\]]*\])|(@\w+):|("[^"]*")|(\()|(\))|(\|)|(-)|(\*[^\s()|"*]+\*?|%{1,3}[^%\s]+%{1,3}|[^\s()|"@{}\[\]]+\*?|\*))')


def parse(query: str):
    """Nested tuples: (and, ...), (or, ...), (not, x), (all,), (none,), (tag|range|text|phrase, field, value)."""
    toks, at, query = [], 0, query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"syntax error at {at}: {query}")
        toks.append(m)
        at = m.end()
    if not toks:
        return ("none",)
    i = 0

    def peek(group: int) -> bool:
        return i < len(toks) and toks[i][group] is not None

    def either(field):
        nonlocal i
        parts = [both(field)]
        while peek(7):
            i += 1
            parts.append(both(field))
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both(field):
        parts = []
        while i < len(toks) and not peek(6) and not peek(7):
            parts.append(one(field))
        if not parts:
            raise ValueError(f"operand expected: {query}")
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def one(field):
        nonlocal i
        if i >= len(toks):
            raise ValueError(f"operand expected: {query}")
        m = toks[i]
        i += 1
        if m[8]:
            return ("not", one(field))
        if m[5]:
            x = either(field)
            if not peek(6):
                raise ValueError(f"unbalanced parenthesis: {query}")
            i += 1
            return x
        if m[1]:
            body = m[2][1:-1].strip()
            return ("tag", m[1][1:], body) if m[2][0] == "{" else ("range", m[1][1:], body.split())
        if m[3]:
            return one(m[3][1:])
        if m[4]:
            return ("phrase", field, m[4][1:-1])
        if m[9] == "*":
            return ("all",)
        if m[9]:
            return ("text", field, m[9])
        raise ValueError(f"operand expected: {query}")

    out = either(None)
    if i < len(toks):
        raise ValueError(f"unbalanced parenthesis: {query}")
    return out


def is_pattern(w: str) -> bool:
    return w.startswith("%") or w.startswith("*") or w.endswith("*")


def term_test(w: str, bytewise: bool = False) -> Callable[[Column], Column]:
    """Whether a token fits a fuzzy word (edits of characters, or of bytes) or one with wildcards."""
    if w.startswith("%"):
        edits, word = len(w) - len(w.lstrip("%")), w.strip("%").lower()
        return lambda x: within_edits(x, F.lit(word), edits, bytewise)
    word = w.strip("*").lower()
    if w.startswith("*"):
        return (lambda x: x.contains(word)) if w.endswith("*") else (lambda x: x.endswith(word))
    return lambda x: x.startswith(word)


def indexed(f: Field, schema: Schema) -> Column:
    """The field's tokens but for stop words, which no query meets."""
    t = tokens(f.col)
    return F.filter(t, lambda x: ~x.isin(*sorted(schema.stop))) if schema.stop else t


def _word(f: Field, w: str, schema: Schema) -> Column:
    t = indexed(f, schema)
    hit = F.exists(t, term_test(w, f.bytewise)) if is_pattern(w) else F.array_contains(tokens(f.col), w.lower())
    if f.stem and (w.startswith("%") or not is_pattern(w)):
        base = stem(w.strip("%").lower(), schema.language)
        hit = hit | F.array_contains(with_stem(t, base, schema.language), base)
    return hit


def _phrase(f: Field, words: list[str], schema: Schema) -> Column:
    t = indexed(f, schema)
    if f.stem:
        t, words = stems(t, schema.language), [stem(w, schema.language) for w in words]
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return joined.contains(f" {' '.join(words)} ")


def compile_query(ast, schema: Schema) -> Column:
    kind = ast[0]
    if kind == "all":
        return F.lit(True)
    if kind == "none":
        return F.lit(False)
    if kind in ("and", "or"):
        parts = [compile_query(x, schema) for x in ast[1:] if kind == "or" or not _is_stop(x, schema)]
        return reduce(lambda a, b: a & b if kind == "and" else a | b, parts) if parts else F.lit(False)
    if kind == "not":
        return ~F.coalesce(compile_query(ast[1], schema), F.lit(False))
    if kind == "tag":
        return F.coalesce(schema.field(ast[1], "TAG").col.cast("string") == ast[2], F.lit(False))
    if kind == "range":
        f, v = schema.field(ast[1], "NUMERIC", "GEO"), ast[2]
        if f.kind == "GEO":
            lon, lat, r = map(float, v[:3])
            x, y = F.split_part(f.col, F.lit(","), F.lit(1)).try_cast("double"), F.split_part(f.col, F.lit(","), F.lit(2)).try_cast("double")
            ok = x.between(-180, 180) & y.between(-90, 90)
            return F.coalesce(ok & (geo.distance_m(x, y, F.lit(lon), F.lit(lat)) <= r * geo.SEARCH_UNITS[v[3]]), F.lit(False))
        low, high = (float({"inf": "1.7976931348623157e308", "+inf": "1.7976931348623157e308", "-inf": "-1.7976931348623157e308"}.get(x.lower(), x)) for x in v)
        return F.coalesce(f.col.between(low, high), F.lit(False))
    fields = [schema.field(ast[1], "TEXT")] if ast[1] else schema.texts
    if kind == "phrase":
        words = [w for w in re.findall(r"\w+", ast[2].lower()) if w not in schema.stop]
        parts = [_phrase(f, words, schema) for f in fields] if words else []
    else:
        parts = [] if _is_stop(ast, schema) else [_word(f, ast[2], schema) for f in fields]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)) if parts else F.lit(False)


def _is_stop(ast, schema: Schema) -> bool:
    return ast[0] == "text" and ast[2].lower() in schema.stop


def plain_words(ast, schema: Schema) -> list[str]:
    """The words of the tree that are neither negated, patterns nor stop words, in written order."""
    if ast[0] in ("and", "or"):
        return [w for x in ast[1:] for w in plain_words(x, schema)]
    return [ast[2].lower()] if ast[0] == "text" and not is_pattern(ast[2]) and not _is_stop(ast, schema) else []


def search(df: DataFrame, query: str, schema: Schema) -> DataFrame:
    """Rows that the query matches."""
    return df.where(compile_query(parse(query), schema))


def explain(query: str) -> str:
    """The query's tree, one node per line."""

    def show(x, depth: int) -> list[str]:
        pad = "  " * depth
        if x[0] in ("and", "or", "not"):
            return [f"{pad}{x[0].upper()} {{", *[line for y in x[1:] for line in show(y, depth + 1)], pad + "}"]
        return [pad + " ".join(str(y) for y in x if y is not None)]

    return "\n".join(show(parse(query), 0))


def tag_values(df: DataFrame, f: str) -> DataFrame:
    return df.select(F.col(f).cast("string").alias("value")).where("value is not null").distinct().orderBy("value")


def _is(word: str):
    return lambda x: x == word


def bm25(df: DataFrame, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that hold a word. The statistics are one pre-aggregated row, so no posting is shuffled."""
    words = [w.lower() for w in words]
    t = df.select(F.col(key), tokens(text).alias("_t"))
    per = t.select(F.col(key), F.size("_t").alias("_dl"), *[F.size(F.filter("_t", _is(w))).alias(f"_tf{i}") for i, w in enumerate(words)])
    stats = per.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(words))])
    both = per.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df_ = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1.0 + (F.col("_n") - df_ + 0.5) / (df_ + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    hit = reduce(lambda x, y: x | y, [F.col(f"_tf{i}") > 0 for i in range(len(words))])
    return both.where(hit).select(key, score.alias("score"))


def spelling(df: DataFrame, text: str, words: list[str], distance: int = 1, bytewise: bool = False) -> DataFrame:
    """For each word that is not in the vocabulary, the vocabulary's words within the distance (in characters, or bytes) and their share of rows."""
    words = sorted({w.lower() for w in words})
    vocabulary = df.select(F.explode(F.array_distinct(tokens(text))).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("rows"))
    near = vocabulary.select("candidate", "rows", F.explode(F.array(*[F.lit(w) for w in words])).alias("word")).where(within_edits(F.col("word"), F.col("candidate"), distance, bytewise))
    known = near.where("word = candidate").select("word")
    total = df.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    out = near.join(known, "word", "left_anti").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return out.select("word", "candidate", (F.col("rows") / F.col("_n")).alias("score"))


def suggest(entries: DataFrame, prefix: str, fuzzy: bool = False, most: int = 5) -> DataFrame:
    """Entries (value, score) that start with the prefix (within one edit if fuzzy), best first."""
    low = F.lower("value")
    hit = (F.levenshtein(F.substring(low, 1, len(prefix)), F.lit(prefix.lower()), 1) >= 0) if fuzzy else low.startswith(prefix.lower())
    return entries.where(hit).orderBy(F.desc("score"), "value").limit(most)


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


_FILTER = re.compile(r"^@(\w+)\s+(==|!=|<=|>=|<|>)\s+(.+)$")
_REDUCERS = {"COUNT": None, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


class Aggregation:
    """Stages in written order over the rows of a search; every stage is lazy."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, condition: str) -> Aggregation:
        """`@f op literal` terms joined by &&; a number only compares with numbers."""
        out = self.df
        for term in condition.split("&&"):
            m = _FILTER.match(term.strip())
            if not m:
                raise ValueError(f"filter: {term}")
            name, op, raw = m.groups()
            if name not in self.df.columns:
                raise ValueError(f"unknown property: {name}")
            raw = raw.strip().strip("\"'")
            try:
                left, right = _number(F.col(name)), F.lit(float(raw))
            except ValueError:
                text = F.col(name).cast("string")
                left, right = F.when(text.try_cast("double").isNull(), text), F.lit(raw)
            ok = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
            out = out.where(ok)
        return Aggregation(out)

    def group(self, by: list[str], **reduce_: tuple[str, str | None]) -> Aggregation:
        """reduce_: alias=(COUNT|SUM|MIN|MAX|AVG, field); groups without numbers give 0."""
        aggs = []
        for alias, (kind, field) in reduce_.items():
            f = _REDUCERS[kind]
            value = F.count("*").cast("double") if f is None else F.coalesce(f(_number(F.col(field))), F.lit(0.0))
            aggs.append(value.alias(alias))
        keys = [F.coalesce(F.col(b).cast("string"), F.lit("")).alias(b) for b in by]
        return Aggregation(self.df.groupBy(*keys).agg(*aggs) if aggs else self.df.select(*keys).distinct())

    def sort(self, *by: tuple[str, str]) -> Aggregation:
        order = [c.desc_nulls_last() if d.upper() == "DESC" else c.asc_nulls_last() for n, d in by for c in [F.col(n)]]
        return Aggregation(self.df.orderBy(*order))

    def limit(self, offset: int, count: int) -> Aggregation:
        if offset < 0 or count < 0:
            raise ValueError("limit")
        return Aggregation((self.df.offset(offset) if offset else self.df).limit(count))

    def load(self, *names: str) -> Aggregation:
        return Aggregation(self.df.select(*names))


def aggregate(df: DataFrame, schema: Schema, query: str, *args: str) -> DataFrame:
    """A whole command: query, then GROUPBY n @f.. REDUCE f n @x AS a, SORTBY n @f ASC|DESC, FILTER, LIMIT, LOAD in any order."""
    agg, a, i = Aggregation(search(df, query, schema)), list(args), 0

    def take(n: int) -> list[str]:
        nonlocal i
        if i + n > len(a):
            raise ValueError("too few arguments")
        out = a[i : i + n]
        i += n
        return out

    while i < len(a):
        word = take(1)[0].upper()
        if word == "FILTER":
            agg = agg.filter(take(1)[0])
        elif word == "LOAD":
            agg = agg.load(*[x.lstrip("@") for x in take(int(take(1)[0]))])
        elif word == "LIMIT":
            agg = agg.limit(*map(int, take(2)))
        elif word == "SORTBY":
            names, n = take(int(take(1)[0])), 0
            by: list[tuple[str, str]] = []
            while n < len(names):
                way = names[n + 1].upper() if n + 1 < len(names) and names[n + 1].upper() in ("ASC", "DESC") else None
                by.append((names[n].lstrip("@"), way or "ASC"))
                n += 2 if way else 1
            agg = agg.sort(*by)
        elif word == "GROUPBY":
            keys, reducers = [x.lstrip("@") for x in take(int(take(1)[0]))], {}
            while i < len(a) and a[i].upper() == "REDUCE":
                kind = take(2)[1].upper()
                fields = [x.lstrip("@") for x in take(int(take(1)[0]))]
                alias = take(2)[1] if i < len(a) and a[i].upper() == "AS" else f"{kind.lower()}_{'_'.join(fields)}"
                if alias in reducers:
                    raise ValueError(f"alias twice: {alias}")
                reducers[alias] = (kind, fields[0] if fields else None)
            agg = agg.group(keys, **reducers)
        else:
            raise ValueError(word)
    return agg.df
