"""SQL for the corpus operators that SQL can express, by brute force over whole tables."""

from __future__ import annotations

from .rules import RATIOS, REPEAT_WINDOW, RULES, STOP_WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    n = REPEAT_WINDOW
    checks = []
    for r in RULES:
        a, b = RATIOS.get(r.measure, (r.measure, None))
        value = f"({a} / nullif({b}, 0))" if b else a
        checks += [f"coalesce({value} >= {r.low}, true)"] if r.low is not None else []
        checks += [f"coalesce({value} <= {r.high}, true)"] if r.high is not None else []
    return rf"""
    with t as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
    win as (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as i from t where len(w) > {n})),
    many as (select doc_id, s from win group by 1, 2 having count(*) > 1),
    held as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {n})) as p from win join many using (doc_id, s)) group by 1),
    m as (select t.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
      length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as n_letters, length(regexp_replace(text, '[^!]+', '', 'g')) as n_exclaim,
      len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(held.n, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop
      from t left join held using (doc_id)),
    f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(checks)} as kept from f"""


_EMBEDDINGS = """
    with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    n as (select a, count(*) as n from links group by 1), c as (select a, min(b) as m from reach group by 1)
    select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(c.m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) as kept
    from embeddings left join n on n.a = vec_id left join c on c.a = vec_id"""

_SHINGLES = rf"""
    with recursive t as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} as w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    c as (select a, min(b) as m from reach group by 1)
    select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(t.doc_id, coalesce(c.m, t.doc_id)) as component_id from t left join n using (doc_id) left join c on c.a = t.doc_id"""

ORACLE_SQL = {"op6_itq": _EMBEDDINGS, "op8_rules": _rules_sql(), "op10_shingles": _SHINGLES}
