"""Sources, text normalisation, corruption rules, duplicates and grounding (S, N, T, D and L series)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.functions import rules, text
from examlake.operators import lines as line_operators
from examlake.operators.duplicates import best_matches, grouped_by_key, representatives, similar_pairs
from examlake.plans.model import OPTIONS, QUESTIONS, nested, table
from examlake.plans.tables import kept as kept_table
from examlake.registry import query

_COMPACT = r"regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]', '', 'g')"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '^[\t\n\f\r ]{{0,3}}#{{1,6}}[\t\n\f\r ]*', ''), '^[\t\n\f\r ]{{0,3}}[-*+][\t\n\f\r ]+', ''), '[*_`]', '', 'g'))"
_COLLAPSE = r"trim(regexp_replace({}, '[\t\n\f\r ]+', ' ', 'g'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", lines)


_LINES = """lines as (
    select doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents
)"""


@query("""with found as (select *, sha256(coalesce(text, '')) as digest from documents), firsts as (select digest, min(doc_id) as first from found group by digest)
select doc_id, digest, case when strlen(coalesce(text, '')) = 0 then 'empty' when strlen(text) > 60000 then 'too_large' when doc_id > first then 'duplicate' else 'stored' end as outcome,
    cast(strlen(coalesce(text, '')) as bigint) as size_bytes from found join firsts using (digest)""")
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each upload's outcome; content already held under a smaller id is a duplicate."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("size_bytes"))
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("first"))
    outcome = F.when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > 60000, "too_large").when(F.col("doc_id") > F.col("first"), "duplicate").otherwise("stored")
    return found.join(firsts, "digest").select("doc_id", "digest", outcome.alias("outcome"), "size_bytes")


@query(f"""with {_LINES} select doc_id, count(*) as blocks, cast(sum(strlen(line)) as bigint) as block_bytes, cast(max(length(line)) as bigint) as longest,
    md5(string_agg(line, chr(10) order by line_no)) as blocks_md5 from lines where {_COLLAPSE.format("line")} <> '' group by doc_id""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's blocks, one for each line that is not blank; sizes are bytes."""
    kept = F.filter(F.split("text", "\n", -1), lambda x: text.collapse(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", kept.alias("b")).where("size(b) > 0")
    return d.select(
        "doc_id",
        F.size("b").cast("long").alias("blocks"),
        F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)).alias("block_bytes"),
        F.array_max(F.transform("b", F.char_length)).cast("long").alias("longest"),
        F.md5(F.array_join("b", "\n").cast("binary")).alias("blocks_md5"),
    )


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[-_ ./]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')) as slug,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages""")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))


@query(f"""with {_LINES} select doc_id, md5(string_agg({_COLLAPSE.format("line")}, chr(10) order by line_no)) as collapsed_md5,
    md5(string_agg({_STRIP.format("line")}, chr(10) order by line_no)) as stripped_md5, cast(sum(len(string_split({_COLLAPSE.format("line")}, ' '))) as bigint) as pieces from lines group by doc_id""")
def line_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line collapsed and stripped of markdown."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, text.collapse).alias("c"), F.transform(lines, text.strip_markdown).alias("s"))
    pieces = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x, " ", -1)))
    return d.select("doc_id", F.md5(F.array_join("c", "\n").cast("binary")).alias("collapsed_md5"), F.md5(F.array_join("s", "\n").cast("binary")).alias("stripped_md5"), pieces.alias("pieces"))


_HEADING = _COLLAPSE.format("replace(" + _COLLAPSE.format(r"""regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(line,
    '(?i)[\(\[]\s*\d+\s*(?:questions?|marks?|qs?)\s*[\)\]]\s*$', ''), '(?i)^\s*(?:part|section|paper|subject|unit|module|tier)\s*[-–—:.]?\s*(?:[ivxlcdm]+|[0-9]+|[a-z])?\s*[-–—:.)]*\s*', '')),
    '[\s&-]', ' ', 'g'), '[^\p{L}\p{Nd} ]', '', 'g')""") + ", ' and ', ' ')")


@query(f"""with {_LINES}, s as (select doc_id, {_STRIP.format("line")} as line from lines), h as (select doc_id, {_HEADING} as heading from s)
select heading, count(*) as n, count(distinct doc_id) as documents from h where heading <> '' group by heading having count(*) > 1""")
def norm_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that become the same heading, with how many documents hold them."""
    h = _lines(spark, sf_dir).select("doc_id", text.heading(F.col("line")).alias("heading")).where("heading <> ''")
    return h.groupBy("heading").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")).where("n > 1")


@query(rf"""with {_LINES}, s as (select doc_id, line, {_STRIP.format("line")} as t from lines),
j as (select doc_id, case when t = '' or length(t) > 90 then false
    when regexp_matches(line, '^[\t\n\f\r ]{{0,3}}#{{1,6}}') or (starts_with(trim(line), '**') and ends_with(trim(line), '**')) then true
    when (ends_with(t, '.') and not ends_with(t, '...') and length(t) > 40) or contains(t, '?') or not regexp_matches(t, '\p{{L}}') then false
    when len(regexp_extract_all(t, '\p{{Lu}}')) > 0.7 * len(regexp_extract_all(t, '\p{{L}}')) then true
    else len(string_split({_COLLAPSE.format("t")}, ' ')) <= 10 end as h from s)
select doc_id, count(*) filter (h) as headings, count(*) as lines from j group by doc_id""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that look like headings."""
    j = _lines(spark, sf_dir).select("doc_id", text.looks_like_heading(F.col("line")).alias("h"))
    return j.groupBy("doc_id").agg(F.count_if("h").alias("headings"), F.count("*").alias("lines"))


@query(f"""with {QUESTIONS}, {OPTIONS}, n as (select question_id, list(k order by k) as ks from (select question_id, {_COMPACT.format("text")} as k from options) where k <> '' group by question_id)
select question_id, sha256(array_to_string(list_concat([{_COMPACT.format("topic || ' ' || subject_name")}], coalesce(ks, [])), '|')) as content_hash from questions left join n using (question_id)""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive fingerprints of questions."""
    return nested(spark, sf_dir).select("question_id", text.content_hash(F.concat_ws(" ", "topic", "subject_name"), F.col("options")["text"]).alias("content_hash"))


@query(f"""with {QUESTIONS}, {OPTIONS}, n as (select question_id, list(k order by k) as ks from (select question_id, {_COMPACT.format("text")} as k from options) where k <> '' group by question_id),
h as (select question_id, sha256(array_to_string(list_concat([{_COMPACT.format("topic || ' ' || subject_name")}], coalesce(ks, [])), '|')) as content_hash from questions left join n using (question_id))
select content_hash, count(*) as copies, min(question_id) as first from h group by content_hash having count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that several questions share."""
    return grouped_by_key(content_hash(spark, sf_dir), "question_id", "content_hash")


@query("""select sha256(text) as digest, count(*) as copies, min(doc_id) as first from documents where text is not null group by text having count(*) > 1""")
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same content."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return grouped_by_key(d, "doc_id", "digest")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"))


@query(r"""with t as (select min(page_id) as id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang from pages group by title, lang),
w as (select id, lang, list_filter(string_split_regex(lower(title), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') as ws from t where strlen(title) >= 40),
g as (select id, lang, list_distinct(flatten(list_transform(ws, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) as g from w),
p as (select a.id as a, b.id as b, cast(len(list_intersect(a.g, b.g)) as bigint) as shared, len(a.g) + len(b.g) as sizes from g a join g b on a.lang = b.lang and a.id < b.id)
select a, b, shared, cast(sizes - shared as bigint) as total from p where 100 * shared >= 40 * (sizes - shared)""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles of one language with similar trigram sets, at a threshold that titles of this corpus reach; near_duplicate_members has the pages behind each id."""
    return similar_pairs(_titles(spark, sf_dir), "page_id", "lang", "title", percent=40)


@query(r"""with t as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang from pages)
select page_id, min(page_id) over (partition by title, lang) as representative from t""")
def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every page the smallest page of its title and language, which stands for it in near_duplicates."""
    return representatives(_titles(spark, sf_dir), "page_id", "lang", "title")


@query()
def near_duplicate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page five copies, then its five nearest pages; tests hold it against all pairs."""
    titles = _titles(spark, sf_dir)
    # Pages without a title have nothing to compare, as questions without a hash.
    members = representatives(titles.where("title <> ''"), "page_id", "lang", "title")
    return best_matches(kept_table(near_duplicates(spark, sf_dir), "pairs"), members, "page_id")


@query(f"""with {QUESTIONS} select subject_id, difficulty, min(question_id) as first, max(question_id) as last, count(*) as n,
    min_by(document_id, question_id) as first_document from questions group by all""")
def passage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared material by key, its range of questions widened to all of them."""
    from examlake.plans.model import questions

    return questions(spark, sf_dir).groupBy("subject_id", "difficulty").agg(F.min("question_id").alias("first"), F.max("question_id").alias("last"), F.count("*").alias("n"), F.min_by("document_id", "question_id").alias("first_document"))


@query(r"""select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang,
    cast(len(regexp_extract_all(html, '<(?:p|li|td|h[1-6])[ >]')) as bigint) as blocks, cast(len(regexp_extract_all(html, '<tr[ >]')) as bigint) as table_rows from pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and the blocks of a page by their tags."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"), count(r"<(?:p|li|td|h[1-6])[ >]").alias("blocks"), count("<tr[ >]").alias("table_rows"))


# The corruption rules as SQL; their patterns are those of functions/rules.py in the other dialect.
_RULE_SQL = r"""list_filter([
    case when contains(t, chr(65533)) then 'unreadable_chars' end,
    case when regexp_matches(t, '(?i)<!--[^>]*-->|\{\{[^}]*\}\}|\$\{[^}]*\}|\[(?:tbd|todo|fixme|xxx|placeholder|image|figure|diagram)\]|\b(?:lorem ipsum|todo|fixme)\b') then 'placeholder' end,
    case when regexp_matches(t, '\\{3,}') then 'backslash_run' end,
    case when regexp_matches(t, '&(?:amp|lt|gt|quot|apos|nbsp|#\d{2,5}|#x[0-9a-fA-F]{2,4});') then 'html_entity' end,
    case when regexp_matches(t, '[ÃÂâÎÐÑ\x{393}\x{2500}-\x{259f}][\x{80}-\x{ff}\x{2000}-\x{206f}\x{20a0}-\x{20bf}\x{2500}-\x{259f}\x{152}\x{153}\x{161}\x{17e}]|ï¿½') then 'mojibake' end,
    case when regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]') then 'control_chars' end,
    case when regexp_matches(t, '(?:' || array_to_string(list_transform(list_distinct(regexp_extract_all(t, '[^ \t\n\r_.*=~0-9-]')), lambda c: '\x{' || printf('%x', unicode(c)) || '}{6}'), '|') || ')') and regexp_matches(t, '[^ \t\n\r_.*=~0-9-]') then 'character_run' end,
    case when contains(t, '|---') or contains(t, '<td') or contains(t, '<tr') or contains(t, '</table') or contains(t, '```') or contains(t, '![') or contains(t, '](http') then 'markdown_residue' end
], lambda x: x is not null)"""


@query(f"""with t as (select page_id, html as t from pages) select page_id, case when trim(t) = '' then [] else {_RULE_SQL} end as codes from t""")
def rules_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corruption rules over raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", rules.inspected(F.col("html")).alias("codes"))


@query(f"""with t as (select doc_id, coalesce(text, '') as t from documents) select doc_id, case when trim(t) = '' then [] else {_RULE_SQL} end as codes from t""")
def rules_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corruption rules over documents."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.inspected(F.coalesce("text", F.lit(""))).alias("codes"))


_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"


@query(f"""with t as (select conv_id, turn, role, {_TOKENS.format("coalesce(text, '')")} as ws, {_COLLAPSE.format("text")} as c from conversations),
s as (select *, coalesce(flatten(list(ws) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)), []) as src from t),
g as (select *, len(list_filter(range(1, len(src) + 1), lambda p: src[p] = ws[1] and list_reduce(list_transform(ws[2:], lambda w: {{'w': w, 'pos': 0::bigint, 'gaps': 0::bigint}}), lambda a, x:
    {{'w': x.w, 'pos': case when a.pos > 0 and coalesce(list_position(src[a.pos + 1:a.pos + 1 + a.gaps], x.w), 0) > 0 then a.pos + list_position(src[a.pos + 1:a.pos + 1 + a.gaps], x.w) else 0 end,
      'gaps': a.gaps - coalesce(list_position(src[a.pos + 1:a.pos + 1 + a.gaps], x.w), 1) + 1}}, {{'w': '', 'pos': p::bigint, 'gaps': (len(ws) // 3 + 2)::bigint}}).pos > 0)) > 0 as in_order from s where role = 'assistant')
select conv_id, turn, cast(len(ws) as bigint) as n_tokens,
    case when len(ws) = 0 then true when len(src) = 0 then false when len(ws) <= 2 then len(list_filter(ws, lambda w: not list_contains(src, w))) = 0
        else contains(' ' || array_to_string(src, ' ') || ' ', ' ' || array_to_string(ws, ' ') || ' ') or in_order end as grounded,
    case when len(ws) = 0 then 1.0 else round(len(list_filter(ws, lambda w: list_contains(src, w))) / len(ws), 6) end as coverage,
    case when length(c) > 160 then left(c, 159) || '…' else c end as evidence
from g""")
def grounding_of_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an assistant's words stand in what was said before, in one run or in order with few gaps, and what share of them does.

    A conversation's words are gathered once; each reply reads those before it.
    """
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.tokens(F.coalesce("text", F.lit(""))).alias("ws"), text.shortened(F.col("text"), 160).alias("evidence"))
    turns = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ws", "evidence"))).alias("turns"))
    start = F.struct(F.lit(0).alias("before"), F.array().cast("array<struct<before:int,turn:bigint,ws:array<string>,evidence:string>>").alias("replies"))

    def step(a: Column, t: Column) -> Column:
        reply = F.struct(a["before"].alias("before"), t["turn"].alias("turn"), t["ws"].alias("ws"), t["evidence"].alias("evidence"))
        return F.struct((a["before"] + F.size(t["ws"])).alias("before"), F.when(t["role"] == "assistant", F.array_append(a["replies"], reply)).otherwise(a["replies"]).alias("replies"))

    gathered = turns.select("conv_id", F.flatten(F.col("turns")["ws"]).alias("all"), F.aggregate("turns", start, step)["replies"].alias("replies"))

    def judged(r: Column) -> Column:
        src = F.slice("all", F.lit(1), r["before"])
        return F.struct(r["turn"].alias("turn"), F.size(r["ws"]).cast("long").alias("n_tokens"), text.grounded(src, r["ws"]).alias("grounded"), F.round(text.coverage(src, r["ws"]), 6).alias("coverage"), r["evidence"].alias("evidence"))

    return gathered.select("conv_id", F.inline(F.transform("replies", judged)))


@query(r"""with r as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as raw_no from documents),
j as (select *, coalesce(regexp_matches(lag(raw) over w, '\p{L}-\s*$') and regexp_matches(trim(raw), '^\p{Ll}'), false) as joins from r window w as (partition by doc_id order by raw_no)),
k as (select *, coalesce(lead(joins) over w, false) as taken, sum((not joins)::int) over (partition by doc_id order by raw_no rows unbounded preceding) as grp from j window w as (partition by doc_id order by raw_no)),
l as (select doc_id, grp, min(raw_no) as raw_no, string_agg(case when taken then regexp_replace(case when joins then trim(raw) else raw end, '-\s*$', '') when joins then trim(raw) else raw end, '' order by raw_no) as line from k group by all)
select doc_id, count(*) as lines, count(*) filter (trim(line) = '') as blank, md5(string_agg(case when trim(line) = '' then '' else line end, chr(10) order by raw_no)) as lines_md5 from l
where not regexp_matches(line, '(?i)^\s*(?:\[?page\]?\s*[:#-]?\s*(\d+)\s*(?:of\s*\d+)?|-{0,3}\s*page\s+(\d+)\s*-{0,3}|<!--\s*page\s*(?:break)?\s*-->|-{3,}|={3,}|\f)\s*$') group by doc_id""")
def prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prepared lines."""
    rows = line_operators.prepared(table(spark, sf_dir, "documents"), "doc_id", "text")
    text_ = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line") == "").alias("blank"), F.md5(text_.cast("binary")).alias("lines_md5"))
