"""SQL that gives the rows of those corpus operators which SQL can express."""

from __future__ import annotations

from trajframe.llm.vector_codes import ENTRIES, PARTS, ROUNDS

LINE_DEDUP = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
cut as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as pos from docs),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from cut),
firsts as (select key, min(doc_id) as lowest from keyed where length(key) >= 10 group by key),
marked as (select k.doc_id, line, pos, coalesce(k.doc_id <> lowest, false) as gone from keyed k left join firsts f on k.key = f.key),
words as (select doc_id, pos // 32 as word, 4294967295 - sum(1::bigint << (pos % 32)::int) as bits from marked where gone group by 1, 2),
maps as (select doc_id, string_agg(word || ':' || bits, ',' order by word) as keep_words from words group by 1)
select m.doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256, coalesce(any_value(keep_words), '') as keep_words
from marked m left join maps on m.doc_id = maps.doc_id group by m.doc_id"""

FILTER_AUDIT = r"""
with recursive orders(filter_order) as (select '' union all select filter_order || c from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) where length(filter_order) < 5 and not contains(filter_order, c)),
steps as (select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as earlier from orders, (select unnest([1, 2, 3, 4, 5]) as step) where length(filter_order) = 5),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
firsts as (select text, min(doc_id) as lowest from texts group by text),
failed as (select d.doc_id, part, concat(case when len(words) < 50 then 'A' else '' end, case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end,
  case when 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) then 'C' else '' end, case when regexp_matches(d.text, '[#$%&*|]') then 'D' else '' end,
  case when d.doc_id > lowest then 'E' else '' end) as mask from texts d join firsts f on d.text = f.text),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
masks as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from failed left join marks using (doc_id) group by part, mask),
measured as (select part, filter_order, step, letter,
  sum(n) filter (where mask = '' or not regexp_matches(mask, '[' || earlier || letter || ']')) as kept,
  sum(n) filter (where contains(mask, letter) and (earlier = '' or not regexp_matches(mask, '[' || earlier || '0]'))) as removed,
  sum(n) filter (where contains(mask, letter) and earlier <> '' and regexp_matches(mask, '[' || earlier || '0]')) as redundant,
  sum(n) filter (where mask = letter) as unique_fails,
  sum(good) filter (where contains(mask, letter) and (earlier = '' or not regexp_matches(mask, '[' || earlier || '0]'))) as good_lost,
  sum(toxic) filter (where contains(mask, letter) and (earlier = '' or not regexp_matches(mask, '[' || earlier || '0]'))) as toxic_lost
  from masks, steps group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley from measured"""


def vector_codes() -> str:
    """Each round of assignment and update written out in turn."""
    out = f"""with kept as (select vec_id, label, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
flat as materialized (select vec_id, (pos - 1) // (d // {PARTS}) as part, (pos - 1) % (d // {PARTS}) as pos, v from (select vec_id, unnest(v) as v, generate_subscripts(v, 1) as pos, len(v) as d from kept)),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select vec_id from kept order by vec_id limit {ENTRIES})),
book0 as materialized (select part, entry, pos, v from flat join seeds using (vec_id))"""
    for r in range(ROUNDS + 1):
        out += f""",
near{r} as materialized (select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (select f.vec_id, f.part, entry, sum((f.v - b.v) * (f.v - b.v))::bigint as d from flat f join book{r} b on f.part = b.part and f.pos = b.pos group by all) group by all)"""
        if r < ROUNDS:
            out += f""",
sum{r} as (select part, entry, pos, sum(v)::bigint as s, count(*) as n from flat join near{r} using (vec_id, part) group by all),
book{r + 1} as materialized (select b.part, b.entry, b.pos, case when n is null then b.v else (s - ((s % n) + n) % n) // n end as v from book{r} b left join sum{r} u on b.part = u.part and b.entry = u.entry and b.pos = u.pos)"""
    out += f""",
codes as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near{ROUNDS} group by vec_id)
select c.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from book{ROUNDS}) as codebooks_sha256
from codes c join kept k on c.vec_id = k.vec_id"""
    return out
