"""SQL for DuckDB of the operators that SQL can express over whole tables.

Fixed values stand in :mod:`vestry.llm.secrets`; the logic is written anew.
"""

from __future__ import annotations

from vestry.llm import secrets


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""
with dw as (select doc_id, {_WORDS} as w from documents),
iw as (select item_id, {_WORDS} as w from benchmark),
pats as (select distinct item_id, array_to_string(w[i:i + least(12, len(w) - 1)], ' ') as p, least(13, len(w)) as n
         from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from iw where len(w) > 0)),
lens as (select distinct n from pats),
occ as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as p
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hits as (select distinct doc_id, i, n, item_id from occ join pats using (p, n)),
cover as (select doc_id, count(distinct pos) as n_hit
          from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, i, n from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from dw left join cover using (doc_id) left join items using (doc_id)
"""

_PATTERNS = [
    ("assign", secrets.ASSIGN, 2, "length(v) >= 12"),
    ("access", secrets.ACCESS, 0, "length(v) >= 18"),
    ("hex", r"[0-9a-f]+", 0, "length(v) >= 16"),
    ("identifier", secrets.IDENTIFIER, 2, "length(v) >= 3"),
    ("short", secrets.ASSIGN, 2, "length(v) between 6 and 11"),
    ("key", r"[A-Za-z0-9+/]+", 0, "length(v) >= 20 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')"),
    ("endpoint", secrets.ENDPOINT, 0, "true"),
]
_ALL = " union all ".join(
    f"select doc_id, '{k}' as kind, string_split_regex(t, {_q(p)}) as gaps, regexp_extract_all(t, {_q(p)}, 0) as ws, regexp_extract_all(t, {_q(p)}, {g}) as vs from docs where regexp_matches(t, {_q(p)})"
    for k, p, g, _ in _PATTERNS
)
_OK = "case kind " + " ".join(f"when '{k}' then {ok}" for k, _, _, ok in _PATTERNS) + " end"
_NEAR = f"b.doc_id = a.doc_id and a.s <= b.e + {secrets.SCOPE} and b.s <= a.e + {secrets.SCOPE}"
_IDS, _KEYS = "b.kind in ('access', 'identifier')", "b.kind in ('assign', 'hex', 'key')"
_ORDER = "list_position(" + str(list(secrets.KINDS)) + ", kind)"

SECRETS = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as ({_ALL}),
flat as (select doc_id, kind, i, length(gaps[i]) as gap, length(ws[i]) as len, vs[i] as v from (select *, unnest(range(1, len(ws) + 1)) as i from found)),
placed as (select *, cast(sum(gap + len) over (partition by doc_id, kind order by i) as bigint) as e from flat),
parts as (select distinct doc_id, case kind when 'short' then 'key' else kind end as kind, e - len as s, e from placed where {_OK}),
strong as (select * from parts where kind in ('assign', 'access', 'hex')),
weak as (select * from parts a where kind not in ('assign', 'access', 'hex') and not exists (select 1 from strong b where b.doc_id = a.doc_id and a.s < b.e and b.s < a.e)),
every_ as (select * from strong union all select * from weak),
linked as (
  select * from weak a where (kind = 'identifier' and exists (select 1 from every_ b where {_NEAR} and {_KEYS}))
    or (kind = 'key' and exists (select 1 from every_ b where {_NEAR} and ({_IDS} or b.kind = 'endpoint')))
    or (kind = 'endpoint' and exists (select 1 from every_ b where {_NEAR} and {_IDS}) and exists (select 1 from every_ b where {_NEAR} and {_KEYS}))),
out_ as (select * from strong union all select * from linked),
texts as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, {_ORDER}, e) as spans,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, {_ORDER}, e) filter (kind in ('assign', 'access', 'hex')) as base,
            count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex
          from out_ group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join texts using (doc_id)
"""
