"""Replies of a language model made from conversations and documents, read back (L series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators import replies as R
from examlake.plans.model import table
from examlake.registry import query

_KINDS = 8
_TICKS = "```"


def _wrapped(literal, kind):
    """A reply around a string literal, in one of eight ways of which two hold no whole object."""
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    made = [
        c('{"t": ', literal, "}"), c(f"{_TICKS}json\n", '{"t": ', literal, ', "n": {"a": [{}]}}', f"\n{_TICKS}\nmore"), c(f"{_TICKS}\n", '{"t": ', literal, "}", f"\n{_TICKS}"), c('Here it is: {"t": ', literal, "} and {more}"),
        c('{"a": {"b": ', literal, '}, "c": 2} done'), c('So {"msg": "a } { brace", "t": ', literal, "}."), c('{"t": ', literal, ', "open": {'), c("no object here ", literal),
    ]
    out = F.lit(None).cast("string")
    for i, m in enumerate(made):
        out = F.when(kind == i, m).otherwise(out)
    return out


@query(rf"""with l as (select conv_id, turn, (conv_id * 3 + turn) % {_KINDS} as kind, '"' || replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' as lit from conversations),
r as (select conv_id, turn, case kind when 0 then '{{"t": ' || lit || '}}' when 1 then '{{"t": ' || lit || ', "n": {{"a": [{{}}]}}}}' when 2 then '{{"t": ' || lit || '}}' when 3 then '{{"t": ' || lit || '}}'
    when 4 then '{{"a": {{"b": ' || lit || '}}, "c": 2}}' when 5 then '{{"msg": "a }} {{ brace", "t": ' || lit || '}}' end as object from l)
select conv_id, turn, md5(object) as object_md5 from r""")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in replies that hold a turn's text: bare, fenced, behind prose, nested, with braces in strings, unclosed and without one."""
    text = F.coalesce("text", F.lit(""))
    literal = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _wrapped(literal, (F.col("conv_id") * 3 + F.col("turn")) % _KINDS).alias("reply"))
    return rows.select("conv_id", "turn", F.md5(R.json_object(F.col("reply")).cast("binary")).alias("object_md5"))


_QUOTE = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"


@query(rf"""with w as (select doc_id, {_QUOTE} as ws from documents), k as (select doc_id, doc_id % 6 as k, ws, array_to_string(ws[1:5], ' ') as quote from w),
d as (select *, k = 4 and len(ws) > 0 as astray from k)
select doc_id, case when k = 5 then null else not astray end as grounded, case when k = 5 then null when astray then ['model_reply_ungrounded/major/'] else list_filter([
    case when k < 3 then ['ambiguous', 'answer_looks_wrong', 'language_broken'][k + 1] || '/' || ['minor', 'critical', 'major'][k + 1] || '/' || ['stem', 'option:2', ''][k + 1] end,
    case when k = 3 then 'not_answerable/critical/' end, case when k = 2 then 'subject_mismatch/major/subject' end], lambda x: x is not null) end as issues from d where k <> 4 or len(ws) > 0""")
def reply_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about documents, each with a quote of its first words, put into replies and read back: known codes, floors of severity, fields that exist, one reply with an invented quote and one that is no object."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("ws"), (F.col("doc_id") % 6).cast("int").alias("k")).where("k <> 4 or size(ws) > 0")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("k") + 1)
    quote = F.when(F.col("k") == 4, "surely never printed words").otherwise(F.array_join(F.slice("ws", 1, 5), " "))
    defect = F.struct(
        pick("Ambiguous", "answer_looks_wrong", "language_broken", "made_up_code", "ambiguous", "ambiguous").alias("code"), pick("minor", "minor", "unheard", "major", "major", "major").alias("severity"),
        pick("stem", "option:2", "option:9", "stem", "stem", "stem").alias("field"), F.lit("said").alias("message"), quote.alias("evidence"),
    )
    reply = F.to_json(F.struct((F.col("k") != 3).alias("answerable"), F.array(defect).alias("defects"), F.lit(7).alias("clarity"), (F.col("k") != 2).alias("subject_fits")))
    rows = docs.select("doc_id", "text", F.lit(4).alias("options"), F.lit("quant").alias("subject"), F.when(F.col("k") == 5, "I cannot say {").otherwise(F.concat(F.lit("Sure:\n```json\n"), reply, F.lit("\n```"))).alias("reply"))
    found = R.reply_issues(rows, "reply", "text", "options", "subject")
    return found.select("doc_id", "grounded", F.transform("issues", lambda i: F.concat_ws("/", i["code"], i["severity"], i["field"])).alias("issues"))


@query("""with o as (select o_custkey as paper, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as number, o_orderkey, count(*) over (partition by o_custkey) as n, cast(6000 * 3 // 4 // count(*) over (partition by o_custkey) as int) as share from orders),
s as (select *, greatest(120, share * 2 // 3) as room, trim(repeat('Which part came first with order ' || o_orderkey || '? ', cast(o_orderkey % 9 + 1 as int))) as stem from o),
t as (select *, number || '. [part ' || o_orderkey % 3 || ' / subject / medium]' || case when o_orderkey % 2 = 0 then ' [has passage]' else '' end || ' answer=b' || chr(10) || '   ' || case when length(stem) > room then left(stem, room - 1) || '…' else stem end || chr(10)
    || case when share > 200 then '   options: first of ' || o_orderkey || ' | ' || repeat('long ', 11) || 'long… | none' || chr(10) else '' end as line from s)
select paper, md5('Questions: ' || any_value(n) || chr(10) || chr(10) || string_agg(line, '' order by number)) as prompt_md5, any_value(n) as questions, max(length(line)) <= 6000 as within from t group by paper""")
def paper_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers shown within a budget that their questions share."""
    from pyspark.sql import Window

    key = F.col("o_orderkey").cast("string")
    stem = F.trim(F.repeat(F.concat(F.lit("Which part came first with order "), key, F.lit("? ")), (F.col("o_orderkey") % 9 + 1).cast("int")))
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("paper"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("number"), F.concat(F.lit("part "), (F.col("o_orderkey") % 3).cast("string")).alias("section"), F.lit("subject").alias("subject"),
        F.lit("medium").alias("difficulty"), (F.col("o_orderkey") % 2 == 0).alias("has_passage"), F.lit("b").alias("answer"), stem.alias("stem"), F.array(F.concat(F.lit("first of "), key), F.lit("long " * 20), F.lit("none")).alias("options"),
    )
    found = R.paper_prompts(items, "paper", 6000)
    return found.select("paper", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "questions", F.lit(True).alias("within"))
