"""DuckDB SQL of the queries that SQL can express."""

from examlake.llm.quality_rules import STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]+"

SQL = {
    "op5_quality_rules": rf"""
with d as (
    select doc_id, coalesce(text, '') as t,
        list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') as ls
    from documents
), tri as (
    select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c
    from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)
), twice as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri) where n > 1
), rep as (
    select doc_id, count(distinct w) as n from (select doc_id, unnest([i, i + 1, i + 2]) as w from twice) group by doc_id
), m as (
    select d.doc_id, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(t, '{_SPACE}', '', 'g')) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) as bigint) as n_lines,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
        len(list_filter(ws, lambda x: list_contains(@STOP@, x))) as n_stop
    from d left join rep using (doc_id)
), b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (not base_failed and n_words <= 1000000 and word_chars / n_words between 2 and 20 and n_symbols / word_chars <= 0.05
        and n_stop / n_words >= 0.02 and n_dup_lines / n_lines <= 0.5) as kept
from b""",
    "op6_warc": """
with p as (
    select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest,
    case when strlen(h) >= 1000 and first > page_id then 'revisit' else 'response' end as record_type,
    case when strlen(h) >= 1000 and first > page_id then first end as refers_to
from p""",
    "op7_line_dedup": rf"""
with d as (
    select doc_id, coalesce(source, '') as host, text from documents
), l as (
    select doc_id, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d
), pages as (select host, count(distinct text) as pages from d group by host),
often as (
    select host, line, count(distinct text) as n from l where regexp_replace(line, '{_SPACE}', '', 'g') <> '' group by host, line
), bad as (
    select host, line from often join pages using (host) where n >= 5 and n > 0.02 * pages
), j as (
    select l.doc_id, l.line, l.pos, bad.line is not null as goes, regexp_replace(l.line, '{_SPACE}', '', 'g') <> '' as has_word
    from l left join bad on l.host = bad.host and l.line = bad.line
), t as (
    select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not goes), '') as left_text,
        count(*) filter (has_word) as n_lines, count(*) filter (goes) as n_dropped from j group by doc_id
)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dropped, 0) as bigint) as n_dropped,
    cast(length(left_text) as bigint) as n_chars_left, md5(left_text) as text_md5
from d left join t using (doc_id)""",
    "op8_decontaminate": r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
    select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as w
    from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)
), dw as (
    select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as w
    from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from bw))
), hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.w = bw.w),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (doc_id) left join items using (doc_id)""",
    "op11_prefix_trie": r"""
with recursive step(i, k, v) as (
  select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where k < 8
), crc as (select list(v order by i) as t from step where k = 8),
own as (
  select conv_id, list([coalesce(role, ''), coalesce(text, '')] order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
  from conversations where conv_id is not null group by conv_id
), headed as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 as h
  from own, crc
), whole as (
  select x.conv_id, list_concat(coalesce(b.turns, [])[1:x.h], x.turns[x.h + 1:]) as turns from headed x left join own b on b.conv_id = x.conv_id - x.conv_id % 20
), members as (
  select conv_id, turns, unnest(range(len(turns) + 1)) as depth from whole
), node as (
  select depth, turns[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(case when len(turns) = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from members group by all
), linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from node k where k.depth = n.depth + 1 and k.path[1:n.depth] = n.path) as n_children,
    case when n.depth = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth][2], '[^\x20\x09-\x0D]+')) end as saved
  from node n left join node p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
), up as (select *, unnest(range(depth + 1)) as above from linked),
total as (select above as depth, path[1:above] as path, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from up group by all)
select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, t.n_leaves, t.saved_tokens, l.ends_sha256 from linked l join total t using (depth, path)""",
}

SQL["op5_quality_rules"] = SQL["op5_quality_rules"].replace("@STOP@", "['" + "','".join(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])) + "']")
