"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op10_mixing"] = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as w
  from sized group by source),
fill(step, rest, open_w) as (
  select 0, (select sum(source_size) from sources)::hugeint, (select sum(w) from sources)::hugeint
  union all
  select f.step + 1,
    ((select sum(source_size) from sources) - 3 * coalesce((select sum(source_size) from sources s
       where s.source_size::hugeint * 3 * f.open_w < f.rest * s.w), 0))::hugeint,
    (select sum(w) from sources s where not s.source_size::hugeint * 3 * f.open_w < f.rest * s.w)::hugeint
  from fill f
  where f.step < 100 and exists (select 1 from sources s where s.source_size::hugeint * 3 * f.open_w < f.rest * s.w)),
level as (select rest, open_w from fill order by step desc limit 1),
targets as (
  select source, source_size,
    case when source_size::hugeint * 3 * open_w < rest * w then (source_size * 3)::double
         else rest::double * w::double / open_w::double end as target
  from sources, level),
ranked as (
  select doc_id, size, s.source, source_size, target, row_number() over (partition by s.source order by size, doc_id) - 1 as k,
    case when source_size > 0 then target / source_size else 0.0 end as rate,
    (('0x' || substr(md5('17:' || coalesce('s' || s.source, 'null')), 1, 5))::int::double + 0.5) / 1048576.0 as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * case when rate >= 3 then 3 else least(floor(u + rate * (k + 1)) - floor(u + rate * k), 3) end)::bigint as taken
from ranked
"""

ORACLES["op8_winnowing"] = rf"""
with item_words as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) as win
  from item_words where len(w) > 0),
lengths as (select distinct n from item_windows),
doc_words as (
  select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
doc_windows as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from doc_words, lengths where len(w) >= n),
hits as (
  select d.doc_id, d.i, d.n, v.item_id
  from (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from doc_windows) d
  join item_windows v on v.win = d.win and v.n = d.n),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, item_id::varchar as name from hits where item_id is not null) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words h on h.doc_id = d.doc_id left join hit_items i on i.doc_id = d.doc_id
"""

ORACLES["op3_minhash_forest"] = rf"""
with recursive doc_words as (
  select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
shingles as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
    lambda i: array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' '))) as s
  from doc_words where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(id, other) as (select a, b from links union select r.id, l.b from reach r join links l on l.a = r.other),
lowest as (select id, min(other) as m from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  d.doc_id <= coalesce(m, d.doc_id) as kept
from doc_words d left join sizes s on s.doc_id = d.doc_id left join lowest on id = d.doc_id
"""

ORACLES["op1_hamming_tables"] = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings),
fine as (
  select * from v where label is not null and len(e) = 64 and list_sum(list_transform(e, lambda x: x * x)) > 0
    and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true)),
links as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, other) as (select a, b from links union select r.id, l.b from reach r join links l on l.a = r.other),
lowest as (select id, min(other) as m from reach group by id),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
  vec_id <= coalesce(m, vec_id) as kept
from v left join counts on a = vec_id left join lowest on id = vec_id
"""

ORACLES["op4_url_rules"] = r"""
with cut as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut),
named as (select *, list_filter(string_split(host, '.'), lambda x: x <> '') as names from parts),
tokened as (
  select page_id, host, path, case when host = '' then []::varchar[] else list_sort(list_distinct(flatten([
    list_transform(range(1, len(names) + 1), lambda i: 'h:' || array_to_string(names[i:], '.')),
    list_transform(list_filter(flatten(list_transform(list_filter(names, lambda x: contains(x, '-')),
      lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''),
      lambda x: 'q:' || string_split(x, '=')[1]),
    case when contains(url, '#') then ['f:'] else []::varchar[] end]))) end as tokens
  from named),
judged as (
  select doc_id, max(coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0) as bad from labels
  where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
labelled as (
  select row_number() over () as i, tokens, bad from tokened join judged on doc_id = page_id where len(tokens) > 0),
least_pages as (select ceil(least(1.0, greatest(0.002::double, 8.0::double / count(*))) * count(*)) as m from labelled),
single as (select i, bad, unnest(tokens) as t from labelled),
sets as (
  select [t] as tokens, bad from single
  union all select [a.t, b.t], a.bad from single a join single b on a.i = b.i and a.t < b.t
  union all select [a.t, b.t, c.t], a.bad from single a join single b on a.i = b.i and a.t < b.t join single c on c.i = a.i and b.t < c.t),
counted as (select tokens, count(*) as n, count(*) filter (where bad) as pages from sets group by tokens),
sure as (
  select tokens, pages, pages / n::double as confidence from counted, least_pages
  where pages >= m and pages / n::double >= 0.6),
rules as (
  select * from sure r where not exists (
    select 1 from sure s where len(s.tokens) < len(r.tokens) and list_has_all(r.tokens, s.tokens) and s.confidence >= r.confidence)),
fits as (
  select page_id, array_to_string(r.tokens, ' ') as mined, confidence,
    row_number() over (partition by page_id order by confidence desc, array_to_string(r.tokens, ' ')) as k
  from tokened t join rules r on list_has_all(t.tokens, r.tokens)),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from tokened)
select r.page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when mined is not null then 'block' else 'allow' end as verdict, mined, confidence
from ruled r left join fits f on f.page_id = r.page_id and f.k = 1
"""

ORACLES["op12_line_dedup"] = rf"""
with texts as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
numbered as (select r, doc_id, unnest(parts) as line, unnest(range(1, len(parts) + 1)) as n from texts),
keyed as (
  select r, doc_id, n, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from numbered),
repeated as (
  select key, max(doc_id) as largest from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.*, p.key is not null and k.doc_id <> p.largest as goes from keyed k left join repeated p on p.key = k.key)
select doc_id, count(*) as n_lines, (count(*) filter (where goes))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not goes), '')) as kept_sha256
from judged group by r, doc_id
"""

# CRC-32 as SQL: a table of 256 remainders, then one step for each byte of the text (DuckDB has no such function).
_CRC_TABLE = """
  select list(list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, b) order by b) as tab
  from (select unnest(range(256)) as b)"""


def _crc32(text: str) -> str:
    """Of a text column, beside a table `crc(tab)` in the same FROM."""
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce({codes}, lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


ORACLES["op11_prefix_trie"] = rf"""
with crc as ({_CRC_TABLE}),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as n
  from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 100 as family, {_crc32("conv_id::varchar")} % 6 as h
  from (select distinct conv_id from turns), crc),
rebuilt as (
  select c.conv_id, 0 as part, t.n, t.role, t.text from convs c join turns t on t.conv_id = c.family and t.n < c.h
  union all
  select c.conv_id, 1, t.n, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.n >= c.h),
steps as (
  select conv_id, role, text, row_number() over w as depth,
    md5(string_agg(md5(length(role) || ':' || role || text), '') over w) as prefix
  from rebuilt window w as (partition by conv_id order by part, n rows unbounded preceding)),
places as (
  select conv_id, depth, prefix, length(text) as chars from steps
  union all select conv_id, 0, '', 0 from convs),
ends as (select conv_id, max(depth) as depth from places group by conv_id),
nodes as (
  select p.depth, p.prefix, min(p.conv_id) as first_conv, count(*) as n_convs, any_value(p.chars) as chars,
    sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where e.depth = p.depth), '')) as ends_sha256,
    bool_and(e.depth = p.depth) as leaf
  from places p join ends e on e.conv_id = p.conv_id group by p.depth, p.prefix),
parents as (
  select n.depth, n.prefix, u.first_conv as parent_conv_id
  from nodes n join places p on p.conv_id = n.first_conv and p.depth = n.depth - 1
  join nodes u on u.depth = p.depth and u.prefix = p.prefix),
children as (
  select p.depth, p.prefix, count(*) as n_children
  from nodes n join places p on p.conv_id = n.first_conv and p.depth = n.depth - 1 group by p.depth, p.prefix),
subtrees as (
  select p.depth, p.prefix, count(*) filter (where n.leaf) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
  from nodes n join places p on p.conv_id = n.first_conv and p.depth <= n.depth group by p.depth, p.prefix)
select n.first_conv as conv_id, n.depth::bigint as depth, parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from nodes n join subtrees s on s.depth = n.depth and s.prefix = n.prefix
left join parents u on u.depth = n.depth and u.prefix = n.prefix
left join children c on c.depth = n.depth and c.prefix = n.prefix
"""

ORACLES["op13_resampling"] = rf"""
with crc as ({_CRC_TABLE}),
texts as (
  select 1 as corpus, row_number() over () as r, doc_id, text from documents
  union all select 0, row_number() over (), item_id, text from benchmark),
words as (
  select corpus, r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from texts),
runs as (
  select corpus, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as run from words),
counted as (select corpus, r, run, count(*) as n from runs group by corpus, r, run),
hashed as (select run, {_crc32("run")} % 10000 as bucket from (select distinct run from counted), crc),
held as (select corpus, r, bucket, n from counted join hashed using (run)),
totals as (
  select coalesce(sum(n) filter (where corpus = 1), 0)::double as s, coalesce(sum(n) filter (where corpus = 0), 0)::double as t from held),
gains as (
  select bucket, floor(1000 * ln((coalesce(sum(n) filter (where corpus = 0), 0)::double + 1) * (s + 10000)
    / ((coalesce(sum(n) filter (where corpus = 1), 0)::double + 1) * (t + 10000))))::bigint as gain
  from held, totals group by bucket, s, t),
weighed as (
  select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight
  from held join gains using (bucket) where corpus = 1 group by r),
scored as (
  select w.doc_id, w.r, len(w.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
  from words w left join weighed using (r) where w.corpus = 1),
ranked as (
  select *, case when n_words >= 20 then row_number() over (order by n_words >= 20 desc, score desc, doc_id) end as place,
    (25 * count(*) filter (where n_words >= 20) over ()) // 100 as drawn
  from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when place <= drawn then place end as rank from ranked
"""
