"""DuckDB SQL for the queries that SQL can express, over the driver's views."""

from __future__ import annotations

from .mixing import MIX, MODULUS

#: A source gives its target in whole words, from the front of its documents in shuffled order, repeated.
_MIX = f"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         ((coalesce(doc_id, -1) % {MODULUS} + {MODULUS}) % {MODULUS} * {MIX} + 12345) % {MODULUS} as t
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
ranked as (
  select *, row_number() over (order by source nulls last) - 1 as rank from sizes),
weighted as (
  select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2 as cap,
         1.5::double * sum(source_size) over () as wanted from ranked),
levels as (
  select *, (wanted - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as here from weighted),
levelled as (select *, max(case when cap / weight > here then here end) over () as level from levels),
targets as (
  select source, source_size, rank,
         case when level is null or cap / weight <= level then cap::double else level * weight end as target from levelled),
line as (
  select d.doc_id, d.source, d.size, t.source_size, t.target, case when t.target > 0 then greatest(1, cast(floor(t.target + 0.5) as bigint)) else 0 end as words,
         coalesce(sum(d.size) over (partition by d.source order by xor(d.t, d.t >> 16), d.doc_id, d.size
           rows between unbounded preceding and 1 preceding), 0) as pos
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(greatest(0, least(size, words - pos)) + greatest(0, least(size, words - source_size - pos)) as bigint) as taken, source
from line"""

#: A turn without a conv_id is a conversation of its own.
_CHAT = """
with t as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
k as (select *, case when conv_id is null then row_number() over () end as lone from t),
c as (
  select conv_id, lone, count(*) as n,
         list(length(role) || ':' || role || chr(31) || text order by turn nulls first, role, sha256(text)) as turns,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                    order by turn nulls first, role, sha256(text)) as rendered
  from k group by conv_id, lone),
whole as (select turns, min(conv_id) as conv_id, max(n) as n_turns, count(*) as n_copies, min(rendered) as rendered from c group by turns),
inner_ as (select distinct turns[1:i] as turns from (select turns, unnest(range(1, n)) as i from c))
select conv_id, n_turns, n_copies, rendered from whole anti join inner_ using (turns)"""

#: All pairs of documents that share a shingle, counted on whole sets, and the least document reachable over links.
_NEAR = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * both_ >= 85 * (x.n + y.n - both_)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as node, b as seen from edges union select r.node, e.b from reach r join edges e on r.seen = e.a),
least as (select node, min(seen) as seen from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(seen, d.doc_id)) as component_id, least(d.doc_id, coalesce(seen, d.doc_id)) = d.doc_id as kept
from documents d left join sizes on d.doc_id = sizes.doc_id left join least on d.doc_id = least.node"""

#: op8 has none: DuckDB has no CRC-32, so a test holds it against plain Python instead. op2 has none
#: either, as its 32-bit signatures are Spark's; a test holds it against sets of word chains.
ORACLE_SQL = {"op1_chat_format": _CHAT, "op6_minhash": _NEAR, "op10_source_mix": _MIX}
