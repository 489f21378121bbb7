"""DuckDB SQL that gives the same rows as a query, where SQL can."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

#: CRC-32 as SQL macros can't be registered: the table of 256 entries from its
#: rule, then a fold over the text's bytes.
_CRC_TABLE = """
crc_table as (
  select list(c order by i) as entry from (
    select i, list_reduce(list_concat([i], range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i)))"""


def _crc(text: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    step = "xor(c >> 8, entry[(xor(c, b) & 255) + 1])"
    folded = f"list_reduce(list_transform({pairs}, lambda p: ('0x' || p)::bigint), lambda c, b: {step}, 4294967295::bigint)"
    return f"case when {text} = '' then 0 else xor({folded}, 4294967295) end"


OP2 = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as s from documents)
select doc_id, min(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept, sha256(s) as text_sha256
from t"""


def mix_cte(docs: str) -> str:
    """CTEs up to ``mixed`` (doc_id, size, source_size, target, repeats) over ``docs``."""
    return rf"""
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::bigint as size,
  ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as u from {docs}),
per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as k from per),
weighed as (select *, [5.0, 2.0, 1.0][(k % 3 + 1)::int]::double as w, source_size * 3.0::double as cap from ranked),
summed as (select *, cap / w as lvl,
  coalesce(sum(cap) over before, 0.0) as full_, coalesce(sum(w) over before, 0.0) as past,
  sum(w) over () as ws, (sum(source_size) over ())::double as total
  from weighed window before as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
water as (select arg_min((total - full_) / (ws - past), (lvl, k)) as lam from summed
  where lvl > (total - full_) / (ws - past)),
aimed as (select source, source_size, coalesce(least(cap, w * lam), cap) as target from summed, water),
split as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from aimed),
mixed as (select d.doc_id, d.size, s.source_size, s.target,
  s.whole + case when s.target - s.whole * s.source_size > 0 and coalesce(sum(d.size) over (partition by d.source order by d.u, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) + d.size / 2.0::double
    <= s.target - s.whole * s.source_size then 1 else 0 end as repeats
  from sized d join split s on d.source is not distinct from s.source)"""


OP3 = f"""with {mix_cte("documents")}
select doc_id, size, source_size, target, (size * repeats)::bigint as taken from mixed"""

OP7 = f"""
with {_CRC_TABLE},
d as (select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, 'null') as key from documents),
drawn as (select doc_id, text, key, list_transform(range(25), lambda i:
  -ln((('0x' || substr(md5(key || '/' || i::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496)) as ts from d),
placed as (select doc_id, text, key, list_position(ts[1:24], list_min(ts[1:24])) - 1 as shard,
  list_position(ts, list_min(ts)) - 1 as grown_shard from drawn),
summed as (select *, strlen(text)::bigint + 8 as size, {_crc("text")} as text_crc32 from placed, crc_table)
select doc_id, size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by substr(md5(key || '/' || size || '/' || text_crc32), 1, 3), doc_id, size, text_crc32) - 1 as slot,
  grown_shard::int as grown_shard
from summed"""


def _render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"


def _mask(turns: str) -> str:
    return f"""coalesce(array_to_string(list_transform({turns}, lambda t: case when t.role = 'assistant'
      then '0:' || (length(t.role) + 5)::varchar || ',1:' || (length(t.text) + 8)::varchar
      else '0:' || (length(t.role) + length(t.text) + 13)::varchar end), ','), '')"""


OP10 = f"""
with entries as (select conv_id, {{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t from conversations),
turns as (
  select conv_id, list(t order by t.turn nulls first, t.role, t.text) as said from entries where conv_id is not null group by conv_id
  union all select conv_id, [t] from entries where conv_id is null),
spoken as (select *, list_filter(range(1, len(said) + 1), lambda i: said[i].role = 'assistant') as spots from turns),
worse as (select *, spots[-1] as last,
  coalesce(list_filter(list_transform(spots, lambda i: said[i].text), lambda x: x <> said[spots[-1]].text)[-1], '') as reply from spoken),
sides as (select conv_id, said as chosen, case when last is null then said
    else list_concat(said[1:last - 1], [{{'turn': said[last].turn, 'role': 'assistant', 'text': reply}}], said[last + 1:]) end as rejected
  from worse),
shared as (select *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
    lambda i: chosen[i].role <> rejected[i].role or chosen[i].text <> rejected[i].text)) - 1,
    least(len(chosen), len(rejected))) as n from sides),
cut as (select conv_id, n, chosen[1:n] as p, chosen[n + 1:] as c, rejected[n + 1:] as r from shared)
select conv_id, n::int as n_prompt_turns, {_render("p")} as prompt,
  {_render("c")} as chosen, {_mask("c")} as chosen_mask,
  {_render("r")} as rejected, {_mask("r")} as rejected_mask,
  len(list_filter(c, lambda t: t.role = 'assistant' and t.text <> '')) > 0
    and len(list_filter(r, lambda t: t.role = 'assistant' and t.text <> '')) > 0 as usable
from cut"""

_LOWER_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: A checksum for each distinct word, then everything by words.
OP12 = rf"""
with {_CRC_TABLE},
spoken as (select row_number() over () as n, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as said from documents),
wanted as (select unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
per as (select n, w, count(*) as c from (select n, unnest(said) as w from spoken) group by n, w),
hashed as (select w, {_crc("w")} % 10000 as b from (select w from per union select w from wanted), crc_table),
s as (select b, sum(c)::double as s from per join hashed using (w) group by b),
t as (select b, count(*)::double as t from wanted join hashed using (w) group by b),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select coalesce(sum(s), 0) from s) + 10000.0::double)
  / ((coalesce(s, 0) + 1.0::double) * ((select coalesce(sum(t), 0) from t) + 10000.0::double))))::bigint as gain
  from s full join t using (b)),
weighed as (select n, sum(c * gain)::bigint as weight from per join hashed using (w) join gain using (b) group by n),
scored as (select n, doc_id, len(said)::bigint as n_features, coalesce(weight, 0)::bigint as weight, len(said) >= 20 as long,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from spoken left join weighed using (n)),
placed as (select *, row_number() over (order by long desc, score desc, doc_id nulls last) as place from scored)
select doc_id, n_features, weight, score,
  case when place <= (select count(*) * 10 // 100 from scored where long) then place end as rank from placed"""

OP13 = rf"""
with rules (host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls as (select row_number() over () as n, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_LOWER_AZ}) as host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
met as (select u.*, r.host || r.path as rule, r.verdict from urls u left join rules r
  on ends_with('.' || u.host, '.' || r.host) and starts_with(u.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from met
qualify row_number() over (partition by n order by length(rule) desc nulls last) = 1"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2,
    "op3_mixing": OP3,
    "op7_sharding": OP7,
    "op10_preference": OP10,
    "op12_importance": OP12,
    "op13_url_filters": OP13,
}
