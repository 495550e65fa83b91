"""Operators against small literal fixtures."""

import pytest
from pyspark.sql import functions as F

from fenwright.functions import arrays, geo, jsonpath, text
from fenwright.operators import keyed, places, ranked, series, sketches, streams, vectors
from fenwright.plans import search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(df, *cols):
    r = df.select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([("a", "one", 1.0), ("a", "two", 2.0), ("b", "one", 3.0), ("b", "three", 4.0)], "key string, member string, score double")


@pytest.mark.parametrize(
    "aggregate, weights, expected",
    [
        ("SUM", [2, 3], {"two": 4, "one": 11, "three": 12}),
        ("MIN", None, {"one": 1, "two": 2, "three": 4}),
        ("MAX", None, {"two": 2, "one": 3, "three": 4}),
        ("COUNT", [5, 7], {"two": 5, "three": 7, "one": 12}),
    ],
)
def test_union(ab, aggregate, weights, expected):
    assert dict(rows(ranked.union(ab, ["a", "b"], weights, aggregate))) == expected


def test_algebra_with_a_plain_set(spark):
    z = spark.createDataFrame([("a", m, float(i)) for i, m in enumerate("abc", 1)] + [("b", m, s) for m, s in (("b", 10.0), ("c", 20.0), ("d", 30.0))], "key string, member string, score double")
    z = z.union(ranked.from_set(spark.createDataFrame([("p", m) for m in "bcx"], "key string, member string")))
    assert rows(ranked.intersect(z, ["a", "b", "p"])) == [("b", 13.0), ("c", 24.0)]
    assert rows(ranked.difference(z, ["a", "b"])) == [("a", 1.0)]


def test_ranks_and_pops(ab):
    assert rows(ranked.rank(ab, reverse=True).where("key = 'a'").select("member", "rank")) == [("one", 1), ("two", 0)]
    assert rows(ranked.range_by_rank(ab, -1, -1).select("member")) == [("three",), ("two",)]
    popped, left = ranked.pop(ab)
    assert rows(popped.select("key", "member")) == [("a", "one"), ("b", "one")] and left.count() == 2
    assert [r.member for r in ranked.pop_first(ab, ["x", "b"], 5).collect()] == ["one", "three"]
    assert rows(ranked.add(ab, ab.limit(1).withColumn("score", F.lit(0.5)), "GT").where("member = 'one' and key = 'a'").select("score")) == [(1.0,)]


def test_sets(spark):
    s = spark.createDataFrame([("x", m) for m in (1, 2, 3)] + [("y", m) for m in (2, 3, 4)] + [("z", 3)], "key string, member int")
    assert rows(keyed.set_union(s, ["x", "z"])) == [(1,), (2,), (3,)]
    assert rows(keyed.set_intersect(s, ["x", "y", "z"])) == [(3,)]
    assert rows(keyed.set_difference(s, ["x", "z"])) == [(1,), (2,)]
    assert keyed.set_intersect_count(s, ["x", "y"], 1).first()[0] == 1
    assert rows(keyed.set_move(s, "x", "z", 1).where("key = 'z'").select("member")) == [(1,), (3,)]


def test_keyed(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "key string, value int")
    assert rows(keyed.upsert(base, new, ["key"])) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(keyed.insert_absent(base, new, ["key"])) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(keyed.update_present(base, new, ["key"])) == [("a", 1), ("b", 9)]
    assert rows(keyed.insert_all_or_nothing(base, new, ["key"])) == rows(base)
    assert rows(keyed.insert_all_or_nothing(base, new.where("key = 'c'"), ["key"])) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(keyed.rename(base, "key", "a", "b")) == [("b", 1)]
    assert rows(keyed.rename(base, "key", "a", "b", only_absent=True)) == [("a", 1), ("b", 2)]
    assert rows(keyed.rename(base, "key", "q", "b")) == [("a", 1), ("b", 2)]
    assert rows(keyed.copy(base, "key", "a", "b")) == [("a", 1), ("b", 2)]
    assert rows(keyed.copy(base, "key", "a", "b", replace=True)) == [("a", 1), ("b", 1)]
    assert keyed.random_rows(base, 5, 1, repeat=True).count() == 5


def test_sort_external(spark):
    ids = spark.createDataFrame([(2,), (1,), (3,)], "id int")
    w = spark.createDataFrame([(1, 20), (2, 10), (3, 30)], "id int, w int")
    names = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Carol")], "id int, name string")
    out = ranked.sort_external(ids, "id", w, get={"name": names}).orderBy("weight").collect()
    assert [r.name for r in out] == ["Bob", "Alice", "Carol"]


def test_series(spark):
    s = spark.createDataFrame([("k", 0, 75.0), ("k", 1, 77.0), ("k", 2, 78.0), ("k", 3, 79.0), ("k", 4, 70.0), ("k", 6, 80.0)], "key string, ts long, value double")
    assert rows(series.downsample(s, "min", 3).select("ts", "value")) == [(0, 75.0), (3, 70.0)]
    t = spark.createDataFrame([("k", 5, 2.0), ("k", 9, 3.0), ("k", 15, 4.0)], "key string, ts long, value double")
    assert rows(series.downsample(t, "sum", 10, 5).select("ts", "value")) == [(5, 5.0)]
    d = spark.createDataFrame([("k", 1000, 5.0, 0), ("k", 1000, 8.0, 1)], "key string, ts long, value double, seq int")
    for policy, want in (("FIRST", 5), ("LAST", 8), ("MIN", 5), ("MAX", 8), ("SUM", 13)):
        assert series.resolve(d, policy).first().value == want
    with pytest.raises(Exception, match="duplicate"):
        series.resolve(d, "BLOCK").collect()
    assert series.retain(s, 2).count() == 2


def test_vectors(spark):
    v = spark.createDataFrame([("k", "east", [1.0, 0.0]), ("k", "north", [0.0, 1.0]), ("k", "west", [-1.0, 0.0])], "key string, element string, vector array<double>")
    assert [tuple(r) for r in vectors.nearest(v, [1, 0]).collect()] == [("east", 1.0), ("north", 0.5), ("west", 0.0)]


def test_neighbours_in_blocks(spark, monkeypatch):
    """As by comparing all pairs at once, also with ties, odd vectors and more rows than a block."""
    import random

    from pyspark.sql import Window

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = random.Random(3)
    made = [("a", i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [("a", 100 + i, [1.0, 2.0, 0.5, -1.0, 3.0]) for i in range(20)]
    odd = [("b", 1, None), ("b", 2, [1.0, None]), ("b", 3, [0.0, 0.0]), ("b", 4, [1.0, 2.0]), ("b", 5, [1.0, 2.0, 3.0]), ("b", 6, [2.0, 1.0]), ("b", 7, [float("nan"), 1.0]), (None, 8, [1.0, 1.0]), ("c", 9, [1.0, 1.0])]
    df = spark.createDataFrame(made + odd, "key string, element long, vector array<double>")
    wanted = df.where("element % 3 = 1 or key = 'b'")
    q = wanted.select("key", F.col("element").alias("of"), F.col("vector").alias("_q"))
    pairs = df.join(q, "key").where("element <> of").select("key", "of", "element", vectors.similarity(F.col("vector"), F.col("_q")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("key", "of").orderBy(F.desc("score"), "element"))).where("rank <= 4")
    assert sorted(map(str, vectors.neighbours(df, wanted, 4).collect())) == sorted(map(str, want.collect()))


def test_geo(spark):
    p = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    c = places.add(p)
    assert rows(c.select("member", "score")) == [("Catania", 3479447370796909.0), ("Palermo", 3479099956230698.0)]
    assert rows(c.select("member", geo.geohash("score"))) == [("Catania", "sqdtr74hyu0"), ("Palermo", "sqc8b49rny0")]
    at = places.positions(c)
    d = at.alias("a").join(at.alias("b"), F.expr("a.member < b.member")).select(geo.distance_m("a.lon", "a.lat", "b.lon", "b.lat")).first()[0]
    assert round(d, 4) == 166274.1516
    near = places.search(p, 15, 37, radius=200, unit="km", descending=False)
    assert [r.member for r in near.collect()] == ["Catania", "Palermo"]


def test_search_and_bm25(spark):
    docs = spark.createDataFrame(
        [("doc:1", "memory guide", "db", 10.0, 30.0), ("doc:2", "memory engine", "db", 20.0, 10.0), ("doc:3", "server guide", "infra", 15.0, 20.0), ("doc:4", "memory server", "infra", 25.0, 40.0), ("doc:5", "cache guide", "db", 30.0, 50.0)],
        "key string, title string, category string, price double, rank double",
    )
    schema = search.Schema(search.Field("title", "TEXT"), search.Field("category", "TAG"), search.Field("price", "NUMERIC"))
    hits = lambda q: [r.key for r in search.search(docs, q, schema).orderBy("key").collect()]
    assert hits("*") == ["doc:1", "doc:2", "doc:3", "doc:4", "doc:5"] and hits("") == []
    assert hits("@title:memory -@category:{infra}") == ["doc:1", "doc:2"]
    assert hits("@title:(server | cache) @price:[15 30]") == ["doc:3", "doc:4", "doc:5"]
    assert hits('"memory server"') == ["doc:4"] and hits("gui*") == ["doc:1", "doc:3", "doc:5"] and hits("%memori%") == ["doc:1", "doc:2", "doc:4"]
    g = search.aggregate(docs, schema, "*", "GROUPBY", "1", "@category", "REDUCE", "SUM", "1", "@price", "AS", "s", "REDUCE", "COUNT", "0", "AS", "n", "REDUCE", "AVG", "1", "@title", "AS", "z")
    assert rows(g) == [("db", 60.0, 3.0, 0.0), ("infra", 40.0, 2.0, 0.0)]
    s = search.aggregate(docs, schema, "*", "SORTBY", "2", "@rank", "ASC", "LIMIT", "1", "2")
    assert [r.title for r in s.collect()] == ["server guide", "memory guide"]
    for bad in (("FILTER", "garbage"), ("LIMIT", "-1", "2"), ("LOAD",)):
        with pytest.raises(ValueError):
            search.aggregate(docs, schema, "*", *bad)
    iso = spark.createDataFrame([("iso:1", "memory"), ("iso:2", "memory memory"), ("iso:3", "memory alpha beta gamma"), ("iso:4", "alpha memory"), ("iso:5", "alpha beta gamma delta")], "key string, title string")
    got = {r.key: 2 * r.score for r in search.bm25(iso, "key", "title", ["memory"]).collect()}
    want = {"iso:1": 0.7689446095, "iso:2": 0.8460367447, "iso:3": 0.4715018479, "iso:4": 0.6353441921}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-8 for k in want)


def test_json(spark):
    doc = '{"items":[{"price":50,"name":"cheap","n":[3,1,2]},{"price":100,"name":"mid","n":[5,6]},{"price":150,"name":"dear","n":[1,"x"]}],"a":{"name":"deep"}}'
    df = spark.createDataFrame([(doc,)], "d string")
    for path, want in {
        "$.items[?(@.price < 100)].name": '["cheap"]',
        "$.items[?(min(@.n)==1)].name": '["cheap"]',
        "$.items[?(@.n.max()==6)].name": '["mid"]',
        "$..name": '["deep","cheap","mid","dear"]',
        "$.items[-1].name": '["dear"]',
        "$.items[0:2].price": "[50,100]",
        "$.items[?(@.price*2 > 250 || @.name =~ '^mi')].name": '["mid","dear"]',
    }.items():
        assert one(df, jsonpath.get("d", path)) == want
    assert one(df, jsonpath.kind("d", "$.items")) == "array" and one(df, jsonpath.object_keys("d")) == ["a", "items"]
    assert one(df, jsonpath.merge("d", '{"items":null,"a":{"name":null,"b":1}}')) == '{"a":{"b":1}}'
    assert '"price":55' in one(df, jsonpath.add_number("d", "$.items[0].price", 5))
    assert one(df, F.get_json_object(jsonpath.delete("d", "$.items[?(@.price>60)]"), "$.items[1]")) is None


def test_lists_and_text(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "b"], "ohmytext", "mynewtext")], "x array<string>, s string, t string")
    assert one(df, arrays.remove("x", -1, "a")) == ["a", "b", "c", "b"]
    assert one(df, arrays.insert("x", True, "c", "z")) == ["a", "b", "z", "c", "a", "b"]
    assert one(df, arrays.positions("x", "b", -1)) == [4, 1]
    assert one(df, arrays.push_left("x", "1", "2"))[:2] == ["2", "1"]
    assert one(df, *arrays.pop_right("x", 2)) == (["b", "a"], ["a", "b", "c"])
    assert one(df, text.lcs("s", "t")) == "mytext"
    assert one(df, text.byte_range("s", -4, -1)) == "text" and one(df, text.set_range("s", 10, "X")) == "ohmytext\0\0X"
    assert one(df, text.bit_count(F.lit("foobar"))) == 26 and one(df, text.get_bit(F.lit("a"), 1)) == 1
    kinds = {"12": "int64", "9223372036854775808": "uint64", "1.5": "float64", "true": "bool", " 10": "string", "1d": "string", "01": "string"}
    assert {k: one(df, text.infer_kind(F.lit(k))) for k in kinds} == kinds


def test_bits_of_all_bytes_and_lengths(spark):
    a = [bytes(range(256)), b"", None, b"\xff" * 8, b"\x00\x80" * 5, b"abcdefg"]
    b = [bytes(reversed(range(200))), b"\x01", b"\x80\x00", b"\xff" * 7, None, b"\x81" * 17]
    df = spark.createDataFrame(list(zip(a, b)), "a binary, b binary")
    assert [r[0] for r in df.select(text.bytes_of("a")).collect()] == [list(x or b"") for x in a]
    f = {"AND": lambda x, y: x & y, "OR": lambda x, y: x | y, "XOR": lambda x, y: x ^ y, "DIFF": lambda x, y: x & ~y, "DIFF1": lambda x, y: y & ~x, "ANDOR": lambda x, y: x & y, "ONE": lambda x, y: x ^ y}
    for r in df.select("a", "b", text.bit_op("NOT", "a").alias("NOT"), *[text.bit_op(o, "a", "b").alias(o) for o in f]).collect():
        x, y = bytes(r.a or b""), bytes(r.b or b"")
        assert r["NOT"] == bytes(255 - v for v in x).hex().upper()
        n = max(len(x), len(y))
        for o, g in f.items():
            assert r[o] == bytes(g(p, q) & 255 for p, q in zip(x.ljust(n, b"\0"), y.ljust(n, b"\0"))).hex().upper(), o


def test_bits_do_not_render_a_text_anew_for_each_byte(spark):
    """A byte costs the same in a long text as in a short one: 40,000 bytes were 1.6 billion digits."""
    import time

    df = spark.createDataFrame([("x" * 40_000, "y" * 40_000)], "a string, b string")
    start = time.monotonic()
    r = df.select(text.bit_op("XOR", "a", "b").alias("x"), text.bit_count("a").alias("n")).first()
    assert r.x == "01" * 40_000 and r.n == 4 * 40_000 and time.monotonic() - start < 10


def test_streams(spark):
    log = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 2, 1)], "key string, ms long, seq long")
    g = spark.createDataFrame([("s", "g", 0, 0)], "key string, grp string, last_ms long, last_seq long")
    pending, moved = streams.deliver(log, g, "c", 100, 2)
    assert rows(moved) == [("s", "g", 2, 0)] and streams.group_lag(log, moved).first().lag == 1
    claimed = streams.claim(pending, "d", 200, 50)
    assert {r.consumer for r in claimed.collect()} == {"d"} and streams.acknowledge(claimed, pending.limit(1)).count() == 1
    assert streams.trim_length(log, 1).select("seq").first()[0] == 1


def test_sketches(spark):
    df = spark.range(5000).selectExpr("id % 1000 as item", "'k' as key")
    n = sketches.distinct_count(sketches.distinct_state(df, ["key"], "item")).first()[0]
    assert abs(n - 1000) < 30
    state = sketches.bloom(df, "item", 1000)
    seen = sketches.bloom_exists(state, spark.range(3000).selectExpr("id as item"), "item", 1000)
    assert seen.where("item < 1000 and not maybe").count() == 0 and seen.where("item >= 1000 and maybe").count() < 80
    assert sketches.frequency(sketches.frequencies(df, "item"), df, "item").where("n < 5").count() == 0
    f = sketches.fingerprints(df, "item")
    assert sketches.fingerprint_count(f, df.limit(1), "item").first().n >= 5
    assert [r.n for r in sketches.top_k(df, "item", 3).collect()] == [5, 5, 5]


def test_bitfield(spark):
    from fenwright.functions import bitfield

    df = spark.createDataFrame([("ab",)], "s string")
    assert one(df, bitfield.get("s", "u8", 8)) == 98 and one(df, bitfield.get("s", "i4", 1)) == -4
    assert one(df, bitfield.increment("s", "u8", 0, 200)["value"]) == (97 + 200) % 256
    assert one(df, bitfield.increment("s", "i8", 0, 200, "SAT")["value"]) == 127
    assert one(df, bitfield.increment("s", "i8", 0, 200, "FAIL")["value"]) is None
    assert bytes(one(df, bitfield.put("s", "u8", 24, 65)["data"])) == b"ab\0A"


def test_indexes(spark):
    from fenwright.plans.indexes import Catalog, near, suggestions

    t = spark.createDataFrame([(1, "alpha beta gamma", 3.0), (2, "alpha gamma beta", None), (3, "beta alpha", 1.0)], "id int, title string, rank double")
    c = Catalog()
    c.create("i", t, "id", search.Field("title", "TEXT"))
    c.alter("i", search.Field("rank", "NUMERIC"))
    c.alias("j", "i")
    assert [r.id for r in c.search("j", "alpha", sort="rank", descending=True).collect()] == [1, 3, 2]
    assert c.info("j").first().rows == 3 and c.names() == ["i"]
    assert [r.id for r in near(t, "title", ["alpha", "beta"]).collect()] == [1]
    assert sorted(r.id for r in near(t, "title", ["alpha", "beta"], slop=1, in_order=False).collect()) == [1, 2, 3]
    log = spark.createDataFrame([("x", 5.0, None, False, 1), ("x", 2.0, "p", True, 2), ("y", 1.0, None, True, 3)], "value string, score double, payload string, incr boolean, seq int")
    assert rows(suggestions(log).select("value", "score")) == [("x", 7.0), ("y", 1.0)]


def test_ranking(spark):
    from fenwright.plans.indexes import Catalog

    texts = ["memory", "memory memory", "memory alpha beta gamma", "alpha memory", "alpha beta gamma delta"]
    iso = spark.createDataFrame([(f"iso:{i + 1}", t) for i, t in enumerate(texts)], "key string, title string")
    two = [("memory", "alpha"), ("alpha", "memory"), ("memory", "memory"), ("memory memory", "alpha"), ("alpha", "alpha")]
    two = spark.createDataFrame([(f"iso:{i + 1}", *t) for i, t in enumerate(two)], "key string, title string, body string")
    c = Catalog()
    c.create("iso", iso, "key", search.Field("title", "TEXT"))
    c.create("two", two, "key", search.Field("title", "TEXT", weight=5), search.Field("body", "TEXT"))

    def same(got, want):
        got = [tuple(r) for r in got.collect()]
        assert [k for k, _ in got] == [k for k, _ in want]
        assert all(abs(a - b) < 2e-8 for (_, a), (_, b) in zip(got, want))

    term = [("iso:2", 0.8460367446819628), ("iso:1", 0.7689446095439446), ("iso:4", 0.6353441920936669), ("iso:3", 0.4715018478678896)]
    same(c.ranked("iso", "@title:memory"), term)
    same(c.ranked("iso", "@title:memory", offset=1, count=2), term[1:3])
    same(c.ranked("iso", "*"), [("iso:1", 1.3364486062523577), ("iso:2", 1.104247106326305), ("iso:4", 1.104247106326305), ("iso:3", 0.8194842380157688), ("iso:5", 0.8194842380157688)])
    weighted = [("iso:3", 0.9491278413584009), ("iso:4", 0.8810735839455638), ("iso:1", 0.8267504344545498), ("iso:2", 0.6110764028585098)]
    same(c.ranked("two", "memory"), weighted)
    # a phrase and a wildcard score by surface terms alone, so half of the term with its stem
    same(c.ranked("iso", '"memory"'), [(k, s / 2) for k, s in term])
    same(c.ranked("iso", "mem*"), [(k, s / 2) for k, s in term])
    same(c.ranked("iso", "%memorx%"), [(k, s / 2) for k, s in term])
    # and adds; not and unmatched branches add nothing
    same(c.ranked("iso", "memory mem* -delta"), [(k, s * 1.5) for k, s in term])
    assert c.ranked("iso", "nothing").count() == 0
    assert c.ranked("iso", "@title:memory").schema == c.ranked("iso", "*").schema


def test_stems(spark):
    from fenwright.functions.stemming import english, german

    families = {"hire": "hire hired hiring hires", "studi": "study studies studied", "run": "run runs running", "search": "searched searching", "relat": "relational", "poni": "ponies", "sky": "skies"}
    assert all(english(w) == s for s, words in families.items() for w in words.split())
    assert {german(w) for w in "haus hauses häuser häusern".split()} == {"haus"} and german("freundlichkeiten") == "freundlich"
    t = spark.createDataFrame([(1, "He studied running"), (2, "a run of studies"), (3, None), (4, ""), (5, "studio")], "id int, text string")
    ids = lambda q, **more: [r.id for r in search.search(t, q, search.Schema(search.Field("text", "TEXT", **more))).orderBy("id").collect()]
    assert ids("study") == [1, 2] and ids("study", stem=False) == [] and ids('"study run"') == [1] and ids("-study") == [3, 4, 5]
    de = search.Schema(search.Field("text", "TEXT"), language="german")
    g = spark.createDataFrame([(1, "viele Häuser"), (2, "Hausen"), (3, "Öfen"), (4, "ofen")], "id int, text string")
    assert [r.id for r in search.search(g, "haus", de).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in search.search(g, "ofen", de).orderBy("id").collect()] == [3, 4]


def test_near(spark):
    from itertools import permutations

    from fenwright.plans.indexes import near

    texts = {i: " ".join(t) for i, t in enumerate(permutations("aabcx"))} | {1000: None, 1001: ""}
    t = spark.createDataFrame(sorted(texts.items()), "id int, text string")

    def brute(text, words, slop, in_order):
        toks = (text or "").split()
        picks = [p for p in permutations(range(len(toks)), len(words)) if [toks[i] for i in p] == words]
        return any(max(p) - min(p) - len(words) + 1 <= slop and (not in_order or list(p) == sorted(p)) for p in picks)

    for words in (["a", "b"], ["a", "a"], ["a", "b", "a"], ["b", "nope"]):
        for slop in (0, 1):
            for in_order in (True, False):
                got = {r.id for r in near(t, "text", words, slop, in_order).collect()}
                assert got == {i for i, x in texts.items() if brute(x, words, slop, in_order)}, (words, slop, in_order)


def test_vector_queries(spark):
    from fenwright.operators import vectors
    from fenwright.plans.indexes import Catalog

    data = [("a", "x", [1.0, 0.0], "one two"), ("b", "y", [0.0, 1.0], "two one"), ("c", "x", [1.0, 1.0], "one and two"), ("d", "x", None, "one"), ("e", "x", [1.0], None), ("f", "x", [0.0, 0.0], ""), ("g", "x", [float("nan"), 1.0], "two")]
    t = spark.createDataFrame(data, "key string, kind string, v array<double>, title string")
    c = Catalog()
    c.create("i", t, "key", search.Field("v", "VECTOR"), search.Field("kind", "TAG"), search.Field("title", "TEXT"))
    ask = lambda q, **more: [r.key for r in c.search("i", q, params={"p": [1.0, 0.0]}, **more).collect()]
    assert ask("*=>[KNN 2 @v $p AS d]") == ["a", "c"] and ask("*=>[KNN 9 @v $p]") == ["a", "c", "b", "f"] and ask("*=>[KNN 0 @v $p]") == []
    assert ask("@kind:{y}=>[KNN 3 @v $p]") == ["b"] and ask("*=>[KNN 2 @v $p AS d]", sort="d", descending=True) == ["c", "a"]
    assert ask("@v:[VECTOR_RANGE 0.5 $p]") == ["a", "c"]
    assert c.search("i", "*=>[KNN 1 @v $p AS d]", params={"p": [1, 0]}, returns=["key", "d"]).first() == ("a", 0.0)
    for bad in ("*=>[KNN 2 @title $p]", "*=>[KNN 2 @v $q]", "*=>[KNN x @v $p]", "@v:[VECTOR_RANGE -1 $p]"):
        with pytest.raises(ValueError):
            ask(bad)
    assert ask("one two", slop=0) == ["a", "b", "c"] and ask("one two", slop=0, in_order=True) == ["a", "c"]
    v = spark.createDataFrame([("k", "a", [1.0], None), ("k", "b", [2.0], '{"y": 3}')], "key string, element string, vector array<double>, attr string")
    w = vectors.set_attributes(v, spark.createDataFrame([("k", "a", '{"y": 1}'), ("k", "b", ""), ("k", "z", "{}")], "key string, element string, attr string"))
    assert rows(w.select("element", "attr")) == [("a", '{"y": 1}'), ("b", None)]
    assert [r.element for r in vectors.nearest(w, [1.0], where=vectors.attribute("y") == "1").collect()] == ["a"]
    assert rows(vectors.attributes(w, spark.createDataFrame([("k", "a"), ("k", "q")], "key string, element string"))) == [("k", "a", '{"y": 1}'), ("k", "q", None)]


def test_dictionaries(spark):
    from fenwright.plans import indexes

    d = spark.createDataFrame([("d", "b"), ("e", "x")], "dict string, term string")
    d = indexes.dictionary_add(d, spark.createDataFrame([("d", "a"), ("d", "b"), ("d", None)], "dict string, term string"))
    assert [r.term for r in indexes.dictionary_terms(d, "d").collect()] == ["a", "b"]
    assert rows(indexes.dictionary_delete(d, spark.createDataFrame([("d", "b"), ("d", "q")], "dict string, term string"))) == [("d", "a"), ("e", "x")]
    log = spark.createDataFrame([("x", 5.0, None, False, 1), ("y", 1.0, None, True, 3)], "value string, score double, payload string, incr boolean, seq int")
    left = indexes.delete_suggestions(log, spark.createDataFrame([("x",)], "value string"))
    assert rows(indexes.suggestion_count(indexes.suggestions(left))) == [(1,)]


def test_folds(spark):
    from fenwright.operators import folds

    log = spark.createDataFrame([("k", 1, 5), ("k", 2, 7), ("k", 3, -2)], "key string, seq int, delta int")
    assert rows(folds.bounded_counter(log, 0, 10)) == [("k", 3, 2)]
    ops = [("k", 1, "acquire", "a", 0, 10), ("k", 2, "acquire", "b", 5, 10), ("k", 3, "acquire", "b", 10, 10), ("k", 4, "renew", "b", 15, 10)]
    assert rows(folds.locks(spark.createDataFrame(ops, "key string, seq int, op string, owner string, now int, ttl int"))) == [("k", "b", 25, 2)]
    i = spark.createDataFrame([("k", 1, "begin", None), ("k", 2, "commit", "r"), ("k", 3, "begin", None)], "key string, seq int, op string, result string")
    assert rows(folds.idempotent(i)) == [("k", "committed", "r")]
    q = spark.createDataFrame([("x", 1, "push", 0), ("x", 2, "pop", 50), ("y", 3, "push", 0), ("z", 4, "pop", 1), ("w", 5, "ack", 3)], "item string, seq int, op string, at int")
    assert dict(rows(folds.queue_counts(folds.queue_states(q, 100, 60)))) == {"active": 1, "waiting": 2, "done": 1}
