"""Question-level rules over the bank (V series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators import question_rules as V
from examlake.plans.model import OPTIONS, QUESTIONS, nested
from examlake.plans.tables import kept
from examlake.registry import query

_ISSUES = f"""{QUESTIONS}, {OPTIONS}, n as (
    select q.question_id, q.subject_id, q.confidence, coalesce(o.n, 0) as n, coalesce(o.right_, 0) as right_
    from questions q left join (select question_id, count(*) as n, count(*) filter (is_correct) as right_ from options group by all) o using (question_id)
), dup as (
    select question_id, position from options qualify row_number() over (partition by question_id, text order by position) > 1
), issues as (
    select question_id, 'no_options' as code, 'critical' as severity, 'options' as field from n where n = 0
    union all select question_id, 'too_few_options', 'critical', 'options' from n where n = 1
    union all select question_id, 'option_count_mismatch', 'major', 'options' from n where n >= 2 and n <> 4
    union all select question_id, 'option_duplicate', 'critical', 'option:' || position from dup
    union all select question_id, 'no_answer', 'critical', 'answer' from n where right_ = 0
    union all select question_id, 'multiple_answers', 'critical', 'answer' from n where right_ > 1
    union all select question_id, 'low_extraction_confidence', 'major', '' from n where confidence > 0 and confidence < 0.7
), judged as (
    select n.question_id, n.subject_id, n.confidence, count(i.code) as issues, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'major') as major
    from n left join issues i using (question_id) group by all
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with ``issues``: V04 to V09 and V18, deduplicated."""
    q = nested(spark, sf_dir)
    none = F.lit(None).cast("string")
    found = F.concat(
        V.option_issues(F.col("options"), F.lit(4)),
        V.answer_issues(F.col("options"), none, none),
        V.when((F.col("confidence") > 0) & (F.col("confidence") < 0.7), "low_extraction_confidence", "major"),
    )
    return q.withColumn("found", found).withColumn("issues", V.deduped(F.col("found"))).drop("found")


@query(f"with {_ISSUES} select question_id, code, severity, field from issues")
def question_options_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each issue; written before they are exploded, as in ``review_by_issue``."""
    return kept(judged(spark, sf_dir).select("question_id", "issues"), "issues").select("question_id", F.inline("issues"))


@query(f"""with {_ISSUES} select question_id, case when critical > 0 then 'failed' when major > 0 then 'review' else 'pass' end as verdict, critical, major,
    round(greatest(0.0, least(1.0, case when confidence > 0 then 0.8 + 0.2 * confidence else 1.0 end - 0.34 * critical - 0.12 * major)), 6) as score from judged""")
def question_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, counts and score of every question."""
    q = judged(spark, sf_dir)
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)).cast("long").alias(s)
    return q.select("question_id", V.verdict(F.col("issues")).alias("verdict"), count("critical"), count("major"), F.round(V.score(F.col("issues"), F.col("confidence")), 6).alias("score"))


@query(f"""with {_ISSUES} select code, severity, count(*) as n, count(distinct question_id) as questions from issues group by all order by n desc, code, severity limit 40""")
def review_by_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty most frequent issues, exploded from the questions.

    Issues are written before they are exploded: else the filter that a
    generator adds would repeat all rules inside itself.
    """
    rows = kept(judged(spark, sf_dir).select("question_id", "issues"), "issues").select("question_id", F.inline("issues"))
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions")).orderBy(F.desc("n"), "code", "severity").limit(40)


@query(f"""with {_ISSUES} select subject_id, case when critical > 0 then 'failed' when major > 0 then 'review' else 'pass' end as verdict, count(*) as n from judged group by all""")
def audit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of the whole bank, tallied by subject and new verdict."""
    return judged(spark, sf_dir).groupBy("subject_id", V.verdict(F.col("issues")).alias("verdict")).agg(F.count("*").alias("n"))


_MADE = """made as (
    select question_id, n, right_, confidence, case question_id % 4 when 0 then 'comprehension' when 1 then 'descriptive' end as type, question_id % 7 = 0 as short, question_id % 8 = 0 as read, question_id % 16 = 0 as thin,
        question_id % 11 = 0 as trails, question_id % 13 = 0 as unsorted, question_id % 17 = 0 as capped, question_id % 19 = 0 as unreadable, question_id % 2 = 0 as reviewed from n
)"""


@query(f"""with {_ISSUES}, {_MADE}, every as (
    select question_id, 'stem_too_short' as code, 'critical' as severity, 'stem' as field from made where short
    union all select question_id, 'no_options', 'critical', 'options' from made where n = 0 and coalesce(type, '') <> 'descriptive'
    union all select question_id, 'too_few_options', 'critical', 'options' from made where n = 1 and coalesce(type, '') <> 'descriptive'
    union all select question_id, 'option_count_mismatch', 'major', 'options' from made where n >= 2 and n <> 4 and coalesce(type, '') <> 'descriptive'
    union all select question_id, 'option_duplicate', 'critical', 'option:' || position from dup
    union all select question_id, 'no_answer', 'critical', 'answer' from made where right_ = 0
    union all select question_id, 'multiple_answers', 'critical', 'answer' from made where right_ > 1 and coalesce(type, '') <> 'descriptive'
    union all select question_id, 'trailing_text', 'major', '' from made where trails
    union all select question_id, 'unclassified_subject', 'major', 'subject' from made where unsorted
    union all select question_id, 'low_extraction_confidence', 'major', '' from made where confidence > 0 and confidence < 0.7
    union all select question_id, 'context_capped', 'minor', '' from made where capped
    union all select question_id, 'unreadable_source', 'critical', '' from made where unreadable
    union all select question_id, 'passage_missing', 'critical', 'passage' from made where type = 'comprehension' and not read
    union all select question_id, 'passage_too_short', 'major', 'passage' from made where type = 'comprehension' and thin
    union all select question_id, 'model_review_not_run', 'minor', '' from made where not reviewed
) select question_id, code, severity, field from every""")
def question_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V00 with V01 to V20: the whole rule set over the bank, with stems, passages and parser findings that follow from the question's number."""
    q, n = nested(spark, sf_dir), F.col("question_id")
    none = F.lit(None).cast("string")
    made = q.select(
        "question_id", "options", "confidence", F.when(n % 4 == 0, "comprehension").when(n % 4 == 1, "descriptive").alias("type"), F.when(n % 7 == 0, "Why?").otherwise(F.concat(F.lit("Select the right value for "), "topic")).alias("stem"),
        none.alias("answer"), none.alias("explanation"), F.when(n % 16 == 0, F.repeat(F.lit("some words "), F.lit(10))).when(n % 8 == 0, F.repeat(F.lit("some words "), F.lit(20))).alias("passage"), F.when(n % 11 == 0, "left over").alias("trailing"),
        F.when(n % 13 == 0, "Unsorted").otherwise("known").alias("subject"), F.filter(F.array(F.when(n % 17 == 0, "context_capped"), F.when(n % 19 == 0, "unreadable_source")), lambda x: x.isNotNull()).alias("parser_issues"), (n % 2 == 0).alias("model_reviewed"),
    )
    found = kept(V.validated(made, expected=4, model_expected=True).select("question_id", "issues"), "question-issues")
    return found.select("question_id", F.inline("issues"))


# What makes a stem a question, as SQL.
_STEM = """(?i)\\?|\\b(?:select|choose|find|identify|which|what|who|whom|whose|when|where|why|how|arrange|rearrange|match|complete|fill|read|consider|calculate|evaluate|simplify|solve|convert|change|spot|pick|state|name|give|compute|determine|examine|compare|correct|incorrect|true|false|appropriate|suitable|meaning|synonym|antonym|value of|following|directions?)\\b|_{3,}|:\\s*$"""


@query(rf"""with s as (select item_id, trim(coalesce(text, '')) as s from benchmark), d as (select *, regexp_matches(s, '(:|\?|…|\.\.\.|_|-|,|=)$') as deliberate, regexp_replace(s, '[ .;]+$', '') as bare from s)
select item_id, list_filter([case when s = '' then 'stem_empty' end, case when s <> '' and length(s) < 12 then 'stem_too_short' end,
    case when length(s) >= 12 and not deliberate and regexp_matches(bare, '(?i)\b(?:and|or|but|the|a|an|of|in|to|for|with|that|which|is|are|was|were|from|by|as|at|on)$') then 'stem_truncated' end,
    case when length(s) >= 12 and not regexp_matches(s, '{_STEM}') then 'stem_not_a_question' end], lambda x: x is not null) as codes from d""")
def stem_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem rules over the benchmark's items."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", V.stem_issues(F.col("text"))["code"].alias("codes"))


@query("""with r as (select doc_id, quality, toxic, n_chars from labels join documents using (doc_id))
select doc_id, quality = 1 and toxic = 0 and n_chars >= 200 as passed, list_filter([case when quality = 0 then 'quality' end, case when toxic = 1 then 'toxic' end, case when n_chars < 200 then 'length' end], lambda x: x is not null) as failed from r""")
def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review passes if every assessed score reaches its threshold and no flag stands."""
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    r = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    failed = F.filter(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "length")), lambda x: x.isNotNull())
    return r.select("doc_id", (F.size(failed) == 0).alias("passed"), failed.alias("failed"))
