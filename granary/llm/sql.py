"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_ESCAPED = r"'<\\*/?s>|\[\\*/?INST\]'"

OP1 = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (
  select *, 20 + length(role) + length(text) + len(regexp_extract_all(role, {_ESCAPED})) + len(regexp_extract_all(text, {_ESCAPED})) as shown,
         row_number() over (partition by conv_id order by turn, role, text) as place, count(*) over (partition by conv_id) as turns from t),
c as (select *, sum(shown) over (partition by conv_id order by place) as prefix from n)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(prefix) filter (where role = 'assistant' or place = turns) as bigint) as formatted_chars
from c group by conv_id"""

_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"


def _rule(host: str, path: str) -> str:
    fits = lambda h, p: f"(({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}'))"
    return (
        f"case when {fits('example.com', '/en/7')} then 'example.com/en/7' when {fits('example.net', '/de/8')} then 'example.net/de/8' "
        f"when {fits('com', '/en/')} then 'com/en/' when {fits('net', '/de/')} then 'net/de/' when {fits('org', '/es/')} then 'org/es/' end"
    )


def _alias(url: str) -> str:
    return rf"case when contains({url}, '://') then translate(regexp_extract({url}, {_PARTS}, 1), {LOWER}) || regexp_replace(regexp_extract({url}, {_PARTS}, 2), '/+$', '') || regexp_extract({url}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) end"


OP2 = rf"""
with recursive p as (
  select page_id, url, html, translate(coalesce(regexp_extract(url, {_PARTS}, 1), ''), {LOWER}) as host, coalesce(regexp_extract(url, {_PARTS}, 2), '') as path, {_alias("url")} as alias from pages),
tags as (select url, path, alias, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from p where contains(url, '://')),
raw as (
  select url, path, alias, replace(trim(case when regexp_matches(tag, '(?is)^<link') then concat(
           regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1), regexp_extract(tag, '(?is)\shref\s*=\s*''([^'']*)''', 1), regexp_extract(tag, '(?is)\shref\s*=\s*([^\s"''>]+)', 1))
         else regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''"\s>;]+)', 1) end), '&amp;', '&') as target
  from tags where regexp_matches(tag, '(?is)^<link\b.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])') or regexp_matches(tag, '(?is)^<meta\b.*\shttp-equiv\s*=\s*["'']?refresh\b')),
based as (
  select *, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as origin,
         case when starts_with(target, '/') then target else coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || target end as joined
  from raw where target <> '' and not starts_with(target, '#')),
clean as (
  select *, list_reduce(list_transform(string_split(regexp_extract(joined, '(?s)^[^?#]*', 0), '/'), lambda s: [s]), lambda a, x: case when x[1] = '..' then a[1 : greatest(len(a) - 1, 1)] when x[1] = '.' then a else list_concat(a, x) end) as segments
  from based),
whole as (
  select alias as a, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target when starts_with(target, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || target
         when starts_with(target, '?') then origin || path || target when not starts_with(target, '/') and regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
         else origin || array_to_string(segments, '/') || regexp_extract(joined, '(?s)^[^?#]*(.*)$', 1) end as t from clean),
edges as (select a, {_alias("t")} as b from whole where a is not null and t is not null),
both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
ruled as (select distinct a as alias, {_rule("translate(regexp_extract('x://' || a, " + _PARTS + ", 1), " + LOWER + ")", "regexp_extract('x://' || a, " + _PARTS + ", 2)")} as rule from both_ways),
found as (select r.a as alias, min(case when u.rule in ('example.com/en/7', 'net/de/') then 'allow' else 'block' end) as found from reach r join ruled u on u.alias = r.b where u.rule is not null group by r.a),
judged as (select page_id, host, path, alias, {_rule("host", "path")} as rule from p)
select page_id, host, path, rule, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' else coalesce(found, 'allow') end as verdict
from judged left join found using (alias)"""

_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP5 = f"""
with d as (select row_number() over () as r, doc_id, {_ALNUM} as w from documents), i as (select distinct coalesce(cast(item_id as varchar), 'null') as item, {_ALNUM} as w from benchmark),
windows as (select distinct item, least(10, len(w)) as m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as x from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct m from windows),
places as (select r, m, k, array_to_string(w[k : k + m - 1], ' ') as x from (select d.r, d.w, s.m, unnest(range(1, len(d.w) - s.m + 2)) as k from d, sizes s where len(d.w) >= s.m)),
hits as (select p.r, p.k, p.m, v.item from places p join windows v on v.m = p.m and v.x = p.x),
words as (select r, count(distinct j) as n from (select r, unnest(range(k, k + m)) as j from hits) group by r),
items as (select r, count(distinct item) as n, string_agg(distinct item, ',' order by item) as names from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""

OP9 = rf"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[k : k + 4], ' ') as x from (select *, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)
  union all select doc_id, 'short ' || array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
links as materialized (
  select a, b from (select p.doc_id as a, q.doc_id as b, count(*) as shared from s p join s q on q.x = p.x and q.doc_id <> p.doc_id group by 1, 2) c join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 85 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on l.a = r.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, doc_id) as component_id, coalesce(c.component_id, doc_id) = doc_id as kept from d left join n using (doc_id) left join c using (doc_id)"""

OP11 = """
with p as (select page_id, encode(coalesce(html, '')) as payload, min(page_id) over (partition by coalesce(html, '')) as least from pages),
d as (select *, sha1(payload) as h, coalesce(page_id <> least, least is not null) as again from p)
select page_id, octet_length(payload) as payload_bytes,
       list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, 5 * k + 1, 5) as bigint) >> s) & 31) + 1 as bigint), 1)), lambda a, b: a || b)), lambda a, b: a || b) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then least end as refers_to from d"""

OP12 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, coalesce(max(quality = 1), false) as good, coalesce(max(toxic = 1), false) as toxic from labels where doc_id is not null group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask
  from d left join l using (doc_id)),
m as (select part, mask, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x from f group by part, mask),
c as (select unnest(string_split('ABCDE', '')) as c),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from c a, c b, c c, c d, c e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as filter, cast(coalesce(list_sum([1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1) for k in range(1, step)]), 0) as bigint) as before, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) as bit
      from o, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, cast(step as int) as step, filter, sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
         sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & bit > 0 then g else 0 end) as good_lost, sum(case when mask & before = 0 and mask & bit > 0 then x else 0 end) as toxic_lost
  from s, m group by part, filter_order, step, filter)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r"""
