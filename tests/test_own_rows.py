"""Queries on rows that the given tables lack give what their SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import plain

TABLES = {
    # words one character but two bytes from the word looked for, and others that are one byte from it
    "documents": "select i as doc_id, t as text, 'en' as lang, 'web' as source, length(t) as n_chars from "
    "(select unnest(range(8)) as i, unnest(['erenst', 'Erenßt ERENT', 'ërenst', 'erenstä', 'erensta', 'érnst x', 'thsï', 'ths thsix']) as t)",
    # two and three events of one type at one time
    "events": "select i as event_id, make_timestamp(1704067200000000 + (i // 3) * 1000000) as ts, 1 as user_id, case when i = 4 then 'view' else 'click' end as event_type, (i + 0.25)::double as value, null::varchar as props from range(12) t(i)",
}


def same_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for t, sql in TABLES.items():
        duck.execute(f"create table {t} as {sql}")
        duck.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    df = entry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    r = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    return want and sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


@pytest.mark.parametrize("name", ["ft_text_fuzzy1", "spell_candidates"])
def test_edits_of_bytes(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name)


def test_decrements_at_one_time(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "ts_decrby_running")
