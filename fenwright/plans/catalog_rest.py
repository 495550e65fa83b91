"""Queries with SQL for commands that the other catalogues leave out: variants, stores and changes of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonpath
from ..operators import keyed, ranked, series, streams, vectors
from ..sources.tables import table
from . import indexes
from .catalog import _E, _O, _X, _Z, L, _customers, _events, _log, _stream, _vectors, _years
from .catalog_more import _M, _members

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# hashes


_H = f"{_O}, h as (select key, field, arg_max(value, seq) as value from o group by 1, 2)"


def _hash(s, d):
    return keyed.latest(_log(s, d), ["key", "field"]).select("key", "field", "value")


@query(f"with {_H} select w.key, w.field, h.value from (values ('1', 'click'), ('1', 'nope'), ('none', 'view')) w(key, field) left join h using (key, field)")
def hmget(s, d):
    wanted = s.createDataFrame([("1", "click"), ("1", "nope"), ("none", "view")], "key string, field string")
    return keyed.lookup(_hash(s, d), wanted, ["key", "field"]).select("key", "field", "value")


@query(f"with {_H} select * from h where not (field = 'click' and key in ('1', '2', '3'))")
def hdel(s, d):
    return keyed.delete(_hash(s, d), s.createDataFrame([(k, "click") for k in ("1", "2", "3")], "key string, field string"), ["key", "field"])


@query(f"with {_H} select * from h union all select 'new', 'click', 1.5::double")
def hsetnx(s, d):
    one = _hash(s, d).orderBy("key", "field").limit(1).select("key", "field", F.lit(0.0).alias("value"))
    return keyed.insert_absent(_hash(s, d), s.createDataFrame([("new", "click", 1.5)], "key string, field string, value double").unionAll(one), ["key", "field"])


# sets and ranked sets


@query(f"with {_M} select key, member from m union all select 'X', member from (select member from m where key = 'F' union select member from m where key = 'O')")
def sunionstore(s, d):
    m = _members(s, d)
    return keyed.store(m, keyed.set_union(m, ["F", "O"]), "X")


@query(f"with {_M} select key, member from m where key <> 'P' union all select 'P', member from (select member from m where key = 'F' except select member from m where key = 'O')")
def sdiffstore(s, d):
    m = _members(s, d)
    return keyed.store(m, keyed.set_difference(m, ["F", "O"]), "P")


@query(f"with {_Z} select key, member, score::double as score from z union all select 'sum', member, sum(score)::double from z where key in ('1995', '1996') group by member")
def zunionstore(s, d):
    z = _years(s, d)
    return keyed.store(z, ranked.union(z, ["1995", "1996"]), "sum").select("key", "member", F.col("score").cast("double").alias("score"))


@query(f"with {_Z} select key, member, score::double as score from z union all select 'both', a.member, (a.score + b.score)::double from z a join z b using (member) where a.key = '1995' and b.key = '1996'")
def zinterstore(s, d):
    z = _years(s, d)
    return keyed.store(z, ranked.intersect(z, ["1995", "1996"]), "both").select("key", "member", F.col("score").cast("double").alias("score"))


@query(f"with {_Z} select key, member, score::double as score from z union all select 'rest', member, score::double from z where key = '1995' and member not in (select member from z where key = '1996')")
def zdiffstore(s, d):
    z = _years(s, d)
    return keyed.store(z, ranked.difference(z, ["1995", "1996"]), "rest").select("key", "member", F.col("score").cast("double").alias("score"))


@query("select c_nationkey::bigint as key, c_name as member, c_acctbal as score from customer where c_name <> 'Customer#000000001'")
def zrem(s, d):
    gone = table(s, d, "customer").where("c_name = 'Customer#000000001'").select(L("c_nationkey").alias("key"), F.col("c_name").alias("member"))
    return keyed.delete(_customers(s, d), gone, ["key", "member"]).select("key", "member", "score")


@query("with w as (select distinct c_nationkey::bigint as key, 'Customer#000000002' as member from customer) select w.key, w.member, c_acctbal as score from w left join customer on key = c_nationkey and member = c_name")
def zmscore(s, d):
    c = _customers(s, d)
    return keyed.lookup(c, c.select("key", F.lit("Customer#000000002").alias("member")).distinct(), ["key", "member"]).select("key", "member", "score")


# series and streams


@query(f"with {_E} select key, ts, value from e where key in ('click', 'view') and ts <= 1705600000000")
def ts_mrange(s, d):
    meta = s.createDataFrame([("click", {"kind": "ui"}), ("view", {"kind": "ui"}), ("error", {"kind": "sys"})], "key string, labels map<string,string>")
    return series.between(series.of_labels(_events(s, d), meta, {"kind": "ui"}), stop=1705600000000).select("key", "ts", "value")


@query("select unnest(['click', 'view']) as key")
def ts_queryindex(s, d):
    meta = s.createDataFrame([("click", {"kind": "ui"}), ("view", {"kind": "ui"}), ("error", {"kind": "sys"})], "key string, labels map<string,string>")
    return series.with_labels(meta, {"kind": "ui"}).select("key")


@query(f"with {_X} select key, ms, seq from x where not (key = 'click' and seq = 0)")
def x_del(s, d):
    x = _stream(s, d)
    return streams.delete(x, x.where("key = 'click' and seq = 0").select("key", "ms", "seq")).select("key", "ms", "seq")


@query(f"with {_X} select key, ms, seq from x where (ms, seq) >= (1705000000000, 0)")
def x_trim_minid(s, d):
    return streams.trim_before(_stream(s, d), (1705000000000, 0)).select("key", "ms", "seq")


# JSON


def _changed(s, d, change):
    """(key, k, a) after a change of {"k": ..., "a": [1, 2, 3], "t": "x", "b": true}."""
    doc = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 2, 3], "t": "x", "b": true}'))
    rows = table(s, d, "events").select(L("event_id").alias("key"), doc.alias("doc"))
    new = change("doc")
    names = {n: F.get_json_object(new, f"$.{n}").alias(n) for n in ("k", "a", "t", "b")}
    return rows.select("key", *names.values())


def _json_sql(k: str = "json_extract_string(props, '$.k')", a: str = "'[1,2,3]'", t: str = "'x'", b: str = "'true'") -> str:
    return f"select event_id::bigint as key, {k} as k, {a} as a, {t} as t, {b} as b from events"


@query(_json_sql(t="'xyz'"))
def json_strappend(s, d):
    return _changed(s, d, lambda c: jsonpath.append_text(c, "$.t", "yz"))


@query(_json_sql(a="'[1,2,3,4,\"five\"]'"))
def json_arrappend(s, d):
    return _changed(s, d, lambda c: jsonpath.append_items(c, "$.a", "4", '"five"'))


@query(_json_sql(a="'[1,9,2,3]'"))
def json_arrinsert(s, d):
    return _changed(s, d, lambda c: jsonpath.insert_items(c, "$.a", 1, "9"))


@query(_json_sql(a="'[1,2]'"))
def json_arrpop(s, d):
    return _changed(s, d, lambda c: jsonpath.pop_item(c, "$.a"))


@query(_json_sql(a="'[2,3]'"))
def json_arrtrim(s, d):
    return _changed(s, d, lambda c: jsonpath.trim_items(c, "$.a", 1, 5))


@query(_json_sql(b="'false'"))
def json_toggle(s, d):
    return _changed(s, d, lambda c: jsonpath.toggle(c, "$.b"))


@query(_json_sql(a="'[]'"))
def json_clear(s, d):
    return _changed(s, d, lambda c: jsonpath.clear(c, "$.a"))


@query("select event_id::bigint as key, 2::integer as len, 1::integer as at, 2::integer as size from events")
def json_lengths(s, d):
    doc = F.lit('{"t": "ab", "a": [1, 2]}')
    return table(s, d, "events").select(
        L("event_id").alias("key"), jsonpath.string_length(doc, "$.t").alias("len"), jsonpath.array_index(doc, "$.a", "2").cast("int").alias("at"), jsonpath.object_length(doc).alias("size")
    )


# search and vectors


@query("select term from (values ('alpha'), ('beta')) t(term)")
def ft_dictdump(s, d):
    old = s.createDataFrame([("d", "beta"), ("e", "gamma"), ("d", "old")], "dict string, term string")
    words = indexes.dictionary_add(old, s.createDataFrame([("d", "alpha"), ("d", "beta")], "dict string, term string"))
    return indexes.dictionary_terms(indexes.dictionary_delete(words, s.createDataFrame([("d", "old")], "dict string, term string")), "d")


@query("select vec_id::bigint as element, case when vec_id % 2 = 0 then 'even' end as parity from embeddings")
def vgetattr(s, d):
    v = _vectors(s, d).withColumn("attr", F.lit(None).cast("string"))
    delta = v.where("element % 2 = 0").select("key", "element", F.lit('{"parity": "even"}').alias("attr"))
    return vectors.set_attributes(v, delta).select("element", vectors.attribute("parity").alias("parity"))
