"""Layout operators over line and box tables that Spark derives from the driver's tables (G series, S18, S19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.operators import glyphs as T
from examlake.operators import layout as G
from examlake.plans.model import table
from examlake.registry import query


@query("""with p as (select distinct l_orderkey as document_id, l_linenumber as page from lineitem), i as (select *, page - row_number() over (partition by document_id order by page) as island from p)
select document_id, min(page) as first, max(page) as last, count(*) as n from i group by document_id, island""")
def contiguous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive page numbers as ranges."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"))
    return G.islands(rows, ["document_id"], "page")


@query("""with m as (select l_orderkey as document_id, max(l_linenumber) as pages from lineitem group by all), e as (select document_id, unnest(range(1, pages + 1)) as page from m)
select document_id, list(page order by page) as missing from e where not exists (select 1 from lineitem where l_orderkey = document_id and l_linenumber = page) group by document_id""")
def glyphless_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document without any line, by an anti join with all its page numbers."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("page"))
    every = rows.groupBy("document_id").agg(F.max("page").alias("pages")).select("document_id", F.explode(F.expr("sequence(1L, pages)")).alias("page"))
    return every.join(rows, ["document_id", "page"], "left_anti").groupBy("document_id").agg(F.sort_array(F.collect_list("page")).alias("missing"))


@query(r"""with l as (select source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
k as (select distinct source, doc_id, regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '[^A-Za-z#]', '', 'g') as key from l), p as (select source, count(distinct doc_id) as pages from l group by source)
select source, md5(key) as key_md5, count(*) as on_pages, any_value(pages) as pages from k join p using (source) where key <> '' group by source, key having count(*) >= 3 and count(*) >= 0.1 * any_value(pages)""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines of a source, with its documents as pages and a tenth of them as the bar."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return G.furniture(lines, "source", "doc_id", "line", share=0.1).select("source", F.md5(F.col("key").cast("binary")).alias("key_md5"), "on_pages", "pages")


_BOXES = """boxes as (
    select l_suppkey as page, l_orderkey as row_id, case when l_linenumber <= 3 then l_quantity * 0.9 else 60 + l_quantity * 0.8 end as x0, 10 + l_tax * 10 as width, -(l_orderkey % 997) as top, l_linenumber <= 3 as is_left, l_returnflag = 'R' and l_linestatus = 'O' as crosses
    from lineitem
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two columns on pages of width 110, from line items: suppliers are pages and orders rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"),
        F.col("l_orderkey").alias("row_id"),
        F.when(F.col("l_linenumber") <= 3, F.col("l_quantity") * 0.9).otherwise(60 + F.col("l_quantity") * 0.8).alias("x0"),
        (10 + F.col("l_tax") * 10).alias("width"),
        (-(F.col("l_orderkey") % 997)).alias("top"),
        (F.col("l_linenumber") <= 3).alias("is_left"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("crosses"),
    )


@query(f"""with {_BOXES}, b as (select page, row_id, unnest(range(least(greatest(floor(x0 / 110 * 240), 0), 239)::int, least(greatest(floor((x0 + width) / 110 * 240), 0), 239)::int + 1)) as bin from boxes),
d as (select distinct page, row_id, bin from b), n as (select page, bin, count(*) as rows_ from d group by all), r as (select page, count(distinct row_id) as all_rows, min(bin) as l, max(bin) as r from d group by page),
e as (select page, all_rows, unnest(range(l, r + 1)) as bin from r), f as (select e.page, e.bin from e left join n on n.page = e.page and n.bin = e.bin where coalesce(rows_, 0) < greatest(1.0, 0.06 * all_rows)),
i as (select page, bin, bin - row_number() over (partition by page order by bin) as island from f), w as (select page, min(bin) as from_bin, max(bin) as to_bin, count(*) as n from i group by page, island),
g as (select w.* from w join r on w.page = r.page where from_bin > r.l and n >= case when to_bin = r.r then 3 else 2 end)
select page, cast(from_bin as int) as from_bin, cast(to_bin as int) as to_bin, n from g qualify row_number() over (partition by page order by n desc, from_bin) <= 4""")
def column_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty vertical bands of each page."""
    return G.gutters(boxes(spark, sf_dir).withColumn("x1", F.col("x0") + F.col("width")), "page", "row_id", "x0", "x1", F.lit(110.0))


@query(f"""with {_BOXES}, r as (select page, top, bool_or(crosses) as crosses, count(*) as n from boxes group by all),
b as (select *, 2 * coalesce(sum(crosses::int) over (partition by page order by top desc rows between unbounded preceding and 1 preceding), 0) + crosses::int as band from r)
select page, cast(band as bigint) as band, count(*) as rows_in_band, cast(sum(n) as bigint) as boxes from b group by all""")
def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between full-width rows."""
    rows = boxes(spark, sf_dir).groupBy("page", "top").agg(F.bool_or("crosses").alias("crosses"), F.count("*").alias("n"))
    return G.bands(rows, "page", "top", "crosses").groupBy("page", F.col("band").cast("long").alias("band")).agg(F.count("*").alias("rows_in_band"), F.sum("n").alias("boxes"))


_GUTTERS = f"""{_BOXES}, b as (select page, row_id, unnest(range(least(greatest(floor(x0 / 110 * 240), 0), 239)::int, least(greatest(floor((x0 + width) / 110 * 240), 0), 239)::int + 1)) as bin from boxes),
d as (select distinct page, row_id, bin from b), n as (select page, bin, count(*) as rows_ from d group by all), r as (select page, count(distinct row_id) as all_rows, min(bin) as l, max(bin) as r from d group by page),
e as (select page, all_rows, unnest(range(l, r + 1)) as bin from r), f as (select e.page, e.bin from e left join n on n.page = e.page and n.bin = e.bin where coalesce(rows_, 0) < greatest(1.0, 0.06 * all_rows)),
i as (select page, bin, bin - row_number() over (partition by page order by bin) as island from f), w as (select page, min(bin) as from_bin, max(bin) as to_bin, count(*) as n from i group by page, island),
g as (select w.* from w join r on w.page = r.page where from_bin > r.l and n >= case when to_bin = r.r then 3 else 2 end qualify row_number() over (partition by w.page order by n desc, from_bin) <= 4)"""


@query(f"""with {_GUTTERS}, ink as (select page, min(x0) as a, max(x0 + width) as z, count(*) as all_ from boxes group by page),
edges as (select page, a as left_ from ink union all select page, (to_bin + 1) * 110.0::double / 240 from g), ends as (select page, z as right_ from ink union all select page, from_bin * 110.0::double / 240 from g),
le as (select *, row_number() over (partition by page order by left_) as k from edges), re as (select *, row_number() over (partition by page order by right_) as k from ends),
wide as (select page, left_, right_ from le join re using (page, k) where right_ - left_ > 0.04 * 110), bounds as (select * from wide union all select page, a, z from ink where page not in (select page from wide)),
held as (select x.page, row_id, x0, b.left_, b.right_, greatest(b.left_ - (x0 + x0 + width) / 2, (x0 + x0 + width) / 2 - b.right_, 0.0) as off, x.rid from (select *, row_number() over () as rid from boxes) x join bounds b on x.page = b.page),
best as (select page, left_, right_ from held qualify row_number() over (partition by rid order by off, left_) = 1), c as (select page, left_, right_, count(*) as n from best group by all)
select c.page, cast(row_number() over (partition by c.page order by left_) - 1 as int) as "column", round(left_, 4) as left_edge, round(right_, 4) as right_edge, n as glyphs from c join ink using (page) where n >= 0.04 * all_""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each page and the boxes in them."""
    found = G.columns(boxes(spark, sf_dir).withColumn("x1", F.col("x0") + F.col("width")), "page", "row_id", "x0", "x1", F.lit(110.0))
    return found.select("page", "column", F.round("left", 4).alias("left_edge"), F.round("right", 4).alias("right_edge"), "glyphs")


@query(f"""with {_BOXES}, l as (select page, is_left, top, cast(min(row_id) as varchar) as text from boxes group by all), g as (select *, top - lead(top) over (partition by page, is_left order by top desc) as gap from l),
p as (select page, is_left, median(gap) filter (gap > 0 and gap < 100) as pitch from g group by all having count(*) >= 4 and count(*) filter (gap > 0 and gap < 100) >= 3)
select g.page, count(*) filter (gap > 0 and gap < 0.6 * pitch and length(text) <= 24 and text similar to '.*[0-9].*' and 2 * len(regexp_extract_all(text, '[0-9]')) >= length(replace(text, ' ', ''))) as stacked, count(*) as lines
from g left join p on g.page = p.page and g.is_left = p.is_left group by g.page""")
def stacked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that follow closer than the page's pitch."""
    lines = boxes(spark, sf_dir).groupBy("page", "is_left", "top").agg(F.min("row_id").cast("string").alias("text"))
    return G.stacked(lines, "page", "is_left", "top", "text")


@query(r"""with s as (select source, doc_id, length(coalesce(text, '')) as n, len(regexp_extract_all(coalesce(text, ''), '[\x{FFFD}\x{E000}-\x{F8FF}]')) as bad,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]')) as ls from documents),
p as (select source, count(*) as pages, count(*) filter (n = 0) as empty, count(*) filter (n > 0 and len(ls) = 0) as unstructured, count(*) filter (n > 0 and len(ls) < 5) as thin, sum(bad) as bad, sum(n) as chars,
    sum(len(list_filter(ls, lambda x: length(x) <= 24 and regexp_matches(x, '[0-9]') and 2 * len(regexp_extract_all(x, '[0-9]')) >= length(replace(x, ' ', ''))))) as stacked from s group by source)
select source, pages, empty, unstructured, thin, cast(bad as bigint) as unreadable, cast(stacked as bigint) as stacked,
    round(greatest(0.0, least(1.0, 1.0 - 0.9 * empty / pages - 0.5 * unstructured / pages - coalesce(0.3 * thin / nullif(pages - empty, 0), 0.0) - case when bad / nullif(chars, 0) > 0.001 then least(0.4, 20 * bad / chars) else 0.0 end - least(0.1, stacked / 400))), 6) as confidence from p""")
def source_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a source, with its documents as pages: empty, unstructured and thin ones, unreadable characters and rows that are mostly digits."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\r\f]"))
    digits = lambda x: F.regexp_count(x, F.lit("[0-9]"))
    numeric = F.size(F.filter(lines, lambda x: (F.char_length(x) <= 24) & (digits(x) > 0) & (2 * digits(x) >= F.char_length(F.replace(x, F.lit(" "))))))
    s = table(spark, sf_dir, "documents").select("source", F.char_length(t).alias("n"), F.size(lines).alias("ls"), numeric.alias("numeric"), F.regexp_count(t, F.lit(r"[\x{FFFD}\x{E000}-\x{F8FF}]")).alias("bad"))
    p = s.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.expr("n = 0")).alias("empty"), F.count_if(F.expr("n > 0 and ls = 0")).alias("unstructured"), F.count_if(F.expr("n > 0 and ls < 5")).alias("thin"),
        F.sum("bad").alias("unreadable"), F.sum("n").alias("chars"), F.sum("numeric").alias("stacked"),
    )
    value = G.confidence(*(F.col(c) for c in ("pages", "empty", "unstructured", "thin", "chars", "unreadable", "stacked")))
    return p.select("source", "pages", "empty", "unstructured", "thin", "unreadable", "stacked", F.round(value, 6).alias("confidence"))


# Glyphs of printed lines from line items: suppliers are pages, orders baselines, some glyphs raised or lowered.
_GLYPHS = """base as (
    select l_suppkey as page, l_orderkey * 8 + l_linenumber as glyph_id, (l_orderkey % 40) * 9.5 + (l_linenumber % 2) * 0.75 as base, (l_partkey % 60) * 4.0 as x0, l_partkey % 11 = 0 as up, l_partkey % 13 = 0 as down,
        substr('abcdefgh0123456789ijklmnopqrstuvwxyz,(', cast((l_partkey * 7 + l_orderkey) % 38 as int) + 1, 1) as char, l_linestatus = 'O' and l_linenumber = 3 as space_before from lineitem
), glyphs as (
    select page, cast(x0 as double) as x0, cast(base + case when up then 3 when down then -3 else 0 end as double) as y0, cast(x0 + case when up or down then 2.5 else 3.5 end as double) as x1,
        cast(base + case when up then 7 when down then 1 else 8 end as double) as y1, char, space_before, glyph_id from base
), ordered as (select *, row_number() over (partition by page order by y1 desc, x0, y0, x1, char, space_before, glyph_id) as k from glyphs),
swept(page, k, row_no, low, high) as (
    select page, k, 0, y0, y1 from ordered where k = 1 union all
    select page, k, case when j then row_no else row_no + 1 end, case when j then least(low, y0) else y0 end, case when j then greatest(high, y1) else y1 end
    from (select g.*, s.row_no, s.low, s.high, least(s.high, g.y1) - greatest(s.low, g.y0) >= least(g.y1 - g.y0, s.high - s.low) * 0.25 as j from swept s join ordered g on g.page = s.page and g.k = s.k + 1)
), placed as (select o.*, s.row_no as "row" from ordered o join swept s using (page, k))"""


def glyph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, x0, y0, x1, y1, char, space_before, glyph_id`` from line items."""
    up, down = F.col("l_partkey") % 11 == 0, F.col("l_partkey") % 13 == 0
    base, x0 = (F.col("l_orderkey") % 40) * 9.5 + (F.col("l_linenumber") % 2) * 0.75, (F.col("l_partkey") % 60) * 4.0
    char = F.substring(F.lit("abcdefgh0123456789ijklmnopqrstuvwxyz,("), ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 38).cast("int") + 1, F.lit(1))
    boxed = {"x0": x0, "y0": base + F.when(up, 3).when(down, -3).otherwise(0), "x1": x0 + F.when(up | down, 2.5).otherwise(3.5), "y1": base + F.when(up, 7).when(down, 1).otherwise(8)}
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), *(c.cast("double").alias(n) for n, c in boxed.items()), char.alias("char"),
        ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3)).alias("space_before"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("glyph_id"),
    )


@query(f"""with recursive {_GLYPHS} select page, "row", count(*) as glyphs, min(y0) as low, max(y1) as high, cast(bit_xor(glyph_id) as bigint) as ids from placed group by all""")
def glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that glyphs form, with a border that depends on the row's own extent."""
    return T.rows(glyph_table(spark, sf_dir), ["page"]).groupBy("page", "row").agg(F.count("*").alias("glyphs"), F.min("y0").alias("low"), F.max("y1").alias("high"), F.bit_xor("glyph_id").alias("ids"))


@query(rf"""with recursive {_GLYPHS}, m as (
    select *, greatest(median(x1 - x0) over w * 0.28, 0.1) as gap_limit, median(y1 - y0) over w as body, median(y0) over w as baseline, row_number() over (partition by page, "row" order by x0, k) as place from placed window w as (partition by page, "row")
), kinds as (
    select *, case when not regexp_matches(char, '^[a-z0-9]$') then '' when y1 - y0 < body * 0.86 and y0 - baseline > body * 0.22 then 'super'
        when y1 - y0 < body * 0.75 and y0 - baseline < -body * 0.22 and y1 < baseline + body * 0.5 then 'sub' else '' end as kind, coalesce(lag(x1) over a is not null and (space_before or x0 - lag(x1) over a > gap_limit), false) as breaks
    from m window a as (partition by page, "row" order by place)
), runs as (select *, sum((breaks or kind <> coalesce(lag_kind, ''))::int) over (partition by page, "row" order by place) as run from (select *, lag(kind) over (partition by page, "row" order by place) as lag_kind from kinds)),
texts as (select page, "row", run, any_value(kind) as kind, bool_or(breaks) as breaks, string_agg(char, '' order by place) as t from runs group by all),
pieces as (
    select *, case when kind = '' or regexp_matches(t, '^[a-z]+$') then t when kind = 'super' and regexp_matches(t, '^[0-9ni]+$') then translate(t, '0123456789ni', '⁰¹²³⁴⁵⁶⁷⁸⁹ⁿⁱ')
            when kind = 'sub' and regexp_matches(t, '^[0-9]+$') then translate(t, '0123456789', '₀₁₂₃₄₅₆₇₈₉') else case when kind = 'super' then '^(' else '_(' end || t || ')' end as piece,
        case when kind = '' then null when regexp_matches(t, '^[a-z]+$') then case when t in ('st', 'nd', 'rd', 'th') then 'ordinals_joined' else 'scripts_flattened' end when kind = 'super' and regexp_matches(t, '^[0-9ni]+$') then 'superscripts'
            when kind = 'sub' and regexp_matches(t, '^[0-9]+$') then 'subscripts' else 'scripts_marked' end as repair from texts
)
select page, "row", trim(string_agg(case when breaks then ' ' else '' end || piece, '' order by run)) as text, count(repair) as repaired, count(*) filter (repair = 'superscripts') as superscripts from pieces group by all""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each row, with word breaks, raised and lowered runs."""
    text = T.rendered(T.rows(glyph_table(spark, sf_dir), ["page"]), ["page"])
    return text.select("page", "row", "text", F.size("repairs").cast("long").alias("repaired"), F.size(F.filter("repairs", lambda r: r == "superscripts")).cast("long").alias("superscripts"))


@query(r"""with d as (select doc_id, replace(replace(coalesce(text, ''), 'a', case when doc_id % 3 = 0 then '`4' else 'a' end), 'ed', case when doc_id % 5 = 0 then '~ 7' else 'ed' end) as t from documents),
c as (select doc_id, t, len(regexp_extract_all(t, '`')) as a, len(regexp_extract_all(t, '`[ \t\n]?[0-9]')) as ah, len(regexp_extract_all(t, '~')) as b, len(regexp_extract_all(t, '~[ \t\n]?[0-9]')) as bh from d),
s as (select doc_id, t, case when ah >= 3 and ah >= 0.8 * a then '`' when bh >= 3 and bh >= 0.8 * b then '~' end as sign from c)
select doc_id, sign, md5(case sign when '`' then regexp_replace(t, '`[ \t\n]?([0-9])', '₹\1', 'g') when '~' then regexp_replace(t, '~[ \t\n]?([0-9])', '₹\1', 'g') else t end) as text_md5 from s""")
def currency_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a currency sign in texts with one of two stand-ins put in, and the texts with it restored."""
    t = F.coalesce("text", F.lit(""))
    t = F.replace(t, F.lit("a"), F.when(F.col("doc_id") % 3 == 0, "`4").otherwise("a"))
    t = F.replace(t, F.lit("ed"), F.when(F.col("doc_id") % 5 == 0, "~ 7").otherwise("ed"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("sign", T.currency(F.col("t")))
    return d.select("doc_id", "sign", F.md5(T.with_currency(F.col("t"), F.col("sign")).cast("binary")).alias("text_md5"))


@query(r"""with d as (select doc_id, replace(replace(replace(coalesce(text, ''), 'an', chr(8216) || 'n' || chr(160) || chr(160)), 'in', chr(64257)), 'or', chr(8203) || chr(8212)) as t from documents)
select doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, chr(8216), chr(39)), chr(160), ' '), chr(64257), 'fi'), chr(8203), ''), chr(8212), '-'), '[ \t]{2,}', ' ', 'g'), ' ')) as text_md5 from d""")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike punctuation, ligatures and blanks put into texts and normalised again; SQL has no composition, so it is left out."""
    t = F.coalesce("text", F.lit(""))
    for plain, odd in (("an", "\u2018n\u00a0\u00a0"), ("in", "\ufb01"), ("or", "\u200b\u2014")):
        t = F.replace(t, F.lit(plain), F.lit(odd))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalised(t, compose=False).cast("binary")).alias("text_md5"))


_LINES = """lines as (
    select l_suppkey as document, l_linenumber as page, row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey, l_quantity) - 1 as ordinal, cast(l_quantity as int) % 3 - 1 as "column", 'line ' || l_orderkey as text, cast(l_quantity as int) % 3 = 0 as is_heading from lineitem
)"""


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document, page, ordinal, column, text, is_heading`` from line items."""
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity")) - 1
    third = F.col("l_quantity").cast("int") % 3
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("page"), place.alias("ordinal"), (third - 1).alias("column"), F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("text"), (third == 0).alias("is_heading"))


@query(f"""with {_LINES}, marked as (select *, case when lag("column") over (partition by document, page order by ordinal) <> "column" then chr(10) else '' end || case when is_heading then '## ' else '' end || text as line from lines),
pages as (select document, page, '[page] ' || page || chr(10) || chr(10) || string_agg(line, chr(10) order by ordinal) || chr(10) as t from marked group by document, page)
select document, md5(string_agg(t, chr(10) order by page)) as markdown_md5 from pages group by document""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as markdown with page marks, blank lines between columns and headings."""
    return T.markdown(laid_out(spark, sf_dir), ["document"]).select("document", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query(f"""with {_LINES} select document, cast(row_number() over (partition by document order by page, ordinal) - 1 as int) as order_index, page as page_no, case when is_heading then 'heading' else 'paragraph' end as block_type, text, 0 as level from lines""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as block records."""
    return T.blocks(laid_out(spark, sf_dir), ["document"])
