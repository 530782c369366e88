"""DuckDB SQL of the queries that SQL can express."""

SQL = {
    "op4_url_filter": r"""
with parts as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages
), cut as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), ruled as (
  select page_id, host, path,
    case when ends_with('.' || host, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
         when ends_with('.' || host, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
         when ends_with('.' || host, '.org') and starts_with(path, '/') then 'org/'
         when ends_with('.' || host, '.com') and starts_with(path, '/fr/') then 'com/fr/'
         when ends_with('.' || host, '.com') and starts_with(path, '/de/') then 'com/de/' end as rule from cut
)
select page_id, host, path, rule, case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block' else 'allow' end as verdict from ruled
""",
    "op7_mixing": r"""
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('42-' || doc_id) as o from documents
), sizes as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::bigint as w
  from base group by source
), levels as (
  select *, sum(source_size) over ()::bigint as total,
    coalesce(sum(3 * source_size) over (order by source_size::double / w, source is null, source rows between unbounded preceding and 1 preceding), 0)::bigint as clamped,
    (sum(w) over (order by source_size::double / w, source is null, source rows between current row and unbounded following))::bigint as remaining
  from sizes
), level as (
  select clamped as c, remaining as l from levels where w * (total - clamped) / remaining <= 3 * source_size order by clamped, remaining limit 1
), plan as (
  select source, source_size, case when clamped >= c and remaining <= l then (w * (total - c))::double / l::double else (3 * source_size)::double end as target
  from levels left join level on true
), needs as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from plan
), ordered as (
  select b.doc_id, b.size, n.source_size, n.target, n.whole,
    round(n.target)::bigint - n.whole * n.source_size
      - coalesce(sum(b.size) over (partition by b.source order by b.o, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0) as room
  from base b join needs n on b.source is not distinct from n.source
)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, room)))::bigint as taken from ordered
""",
    "op2_decontaminate": r"""
with dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), bw as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bk as (select item, w, least(13, len(w)) as k from bw where len(w) > 0
), bwin as (
  select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as g from (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from bk)
), pos as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from bwin))
), hit as (select doc_id, i, pos.k, item from pos join bwin on pos.k = bwin.k and pos.g = bwin.g
), n_hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hit) group by doc_id
), items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join n_hits using (doc_id) left join items using (doc_id)
""",
    "op5_substring_dedup": r"""
with dw as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), pos as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from dw)
), firsts as (select g, min(doc_id) as d from pos group by g
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from pos join firsts using (g) where doc_id > d
), words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from dw
), kept as (
  select doc_id, count(gone.j) as n_removed, string_agg(x, ' ' order by words.j) filter (gone.j is null) as k
  from words left join gone using (doc_id, j) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256 from dw left join kept using (doc_id)
""",
    "op3_suffix_array": r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents
), pos as (select doc_id, i, md5(b[i:i + 399]) as g from (select doc_id, b, unnest(range(1, octet_length(b) - 398)) as i from d)
), twice as (select g from pos group by g having count(*) > 1
), hit as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from pos where g in (select g from twice)
), runs as (select doc_id, i, count(*) filter (gap is null or gap > 400) over (partition by doc_id order by i) as r from hit
), spans as (select doc_id, r, min(i) as s, max(i) + 400 as e from runs group by doc_id, r
), cut as (select doc_id, list(s order by s) as ss, list(e order by s) as es, sum(e - s)::bigint as n_removed from spans group by doc_id
), kept as (
  select doc_id, n_removed, len(ss) as n_spans, octet_length(b) as n,
    array_to_string(list_transform(range(1, len(ss) + 2), lambda k: hex(b[case when k = 1 then 1 else es[k - 1] end:case when k > len(ss) then octet_length(b) else ss[k] - 1 end])), '') as h
  from d join cut using (doc_id)
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(unhex(h), b)) as kept_sha256
from d left join kept using (doc_id)
""",
}
