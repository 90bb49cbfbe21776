"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Unsigned CRC-32 of an expression's decimal digits, bit by bit.
def crc32(number: str) -> str:
    steps = f"flatten(list_transform(string_split(cast({number} as varchar), ''), lambda d: [cast(ascii(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], {steps}), lambda c, x: {step}), 4294967295)"


def _field(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"case when ({value}) is null then '-' else cast(strlen({text}) as varchar) || ':' || {text} end"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, pos, n, node) above ``leaves`` (g, pos, n, node), pairs at a time."""
    return f"""{name} as (
  select g, 0 as level, pos, n, node from {leaves}
  union all
  select g, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' order by pos))
  from {name} where n > 1 group by g, level, pos // 2)"""


MERKLE = f"""
with recursive rows as (
  select doc_id, {_leaf('n_chars')} as leaf,
         case when {crc32('doc_id')} % 7 = 0 then {_leaf('n_chars + 1')} end as changed,
         case when lang is null then '' else '=' || lang end as g
  from documents),
leaves as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf, changed) - 1 as pos, count(*) over (partition by g) as n, leaf as node
  from rows),
{_tree('low', 'leaves')},
subroots as (select g as own, node from low where n = 1),
tops as (select '' as g, own, row_number() over (order by own) - 1 as pos, count(*) over () as n, node from subroots),
{_tree('high', 'tops')},
steps as (
  select l.doc_id, l.leaf, t.level, t.pos, s.node as sibling
  from leaves l join low t on t.g = l.g and t.pos = l.pos // (1 << t.level) and t.n > 1
       left join low s on s.g = t.g and s.level = t.level and s.pos = xor(t.pos, 1)
  union all
  select l.doc_id, l.leaf, 1000 + t.level, t.pos, s.node
  from leaves l join tops u on u.own = l.g join high t on t.pos = u.pos // (1 << t.level) and t.n > 1
       left join high s on s.level = t.level and s.pos = xor(t.pos, 1)),
paths as (
  select doc_id, leaf, string_agg(coalesce(sibling, ''), '' order by level) as siblings,
         list(struct_pack(l := case when pos % 2 = 1 then sibling else '' end, r := case when pos % 2 = 0 then coalesce(sibling, '') else '' end) order by level) as path
  from steps group by doc_id, leaf),
folded as (
  select l.doc_id, l.leaf, l.g, 0 as k, coalesce(l.changed, l.leaf) as node, p.path, p.siblings
  from leaves l left join paths p on p.doc_id is not distinct from l.doc_id and p.leaf = l.leaf
  union all
  select doc_id, leaf, g, k + 1, sha256(path[k + 1].l || node || path[k + 1].r), path, siblings from folded where k < len(path))
select f.doc_id, f.leaf, s.node as subroot, r.node as root, sha256(coalesce(f.siblings, '')) as proof_sha256,
       f.node as folded_root, f.node = r.node as verified
from folded f join subroots s on s.own = f.g cross join (select node from high where n = 1) r
where f.k = coalesce(len(f.path), 0)"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select row, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs),
keyed as (select *, translate(trim(line, {_SPACE}), '{UPPER}', '{UPPER.lower()}') as key from lines),
common as (select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.*, c.key is not null and k.doc_id <> c.last as dropped from keyed k left join common c on c.key = k.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by row"""

PHRASES = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
grams as (select lang, unnest(list_zip(w, w[2:], w[3:])) as g from words where len(w) > 0),
trios as materialized (select lang, g[1] as x, g[2] as y, g[3] as z, count(*) as f from grams group by all),
f1 as (select lang, x as phrase, cast(sum(f) as bigint) as f from trios group by all),
f2 as (select lang, x, y, cast(sum(f) as bigint) as f from trios where y is not null group by all having sum(f) >= 10),
f3 as (select lang, x, y, z, f from trios where z is not null and f >= 10),
above as (
  select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) e group by all),
total as (select lang, cast(sum(f) as bigint) as n from f1 group by lang),
two as (
  select c.lang, c.x || ' ' || c.y as phrase, c.f as a, l.f as l, r.f as r, cast((1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) as bigint) as score
  from f2 c join f1 l on l.lang = c.lang and l.phrase = c.x join f1 r on r.lang = c.lang and r.phrase = c.y
       left join above b on b.lang = c.lang and b.x = c.x and b.y = c.y
  where b.f is null or 100 * b.f < 50 * c.f),
cuts as (
  select c.lang, c.x || ' ' || c.y || ' ' || c.z as phrase, c.f as a, 1 as k, l.f as l, r.f as r
  from f3 c join f1 l on l.lang = c.lang and l.phrase = c.x join f2 r on r.lang = c.lang and r.x = c.y and r.y = c.z
  union all
  select c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  from f3 c join f2 l on l.lang = c.lang and l.x = c.x and l.y = c.y join f1 r on r.lang = c.lang and r.phrase = c.z),
three as (
  select lang, phrase, a, l, r, score from (
    select *, row_number() over (partition by lang, phrase order by score, k) as nth from (
      select *, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from cuts) s) m where nth = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from (select * from two union all select * from three) u)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join total t on t.lang = r.lang where r.rank <= 2000"""

ORACLES: dict[str, str] = {"op11_merkle": MERKLE, "op12_line_dedup": LINES, "op13_collocations": PHRASES}
