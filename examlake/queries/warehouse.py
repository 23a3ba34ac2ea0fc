"""Warehouse, link, review and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.operators.links import all_links, associated_links, direct_links
from examlake.plans.model import ASSOCIATIONS_SQL, OPTIONS, QUESTIONS, associations, exams, options, questions, subjects, table
from examlake.registry import query

_LINKS = f"""{QUESTIONS}, {ASSOCIATIONS_SQL}, every as (
    select question_id, exam_id, 'direct' as link_type, 1.0::double as relevance, null::int as association_id from questions
    union all
    select question_id, a.exam_id, 'associated', case when similarity > 0 then least(similarity, 1.0)::double else 0.5::double end, association_id
    from questions q join associations a on a.source_exam_id = q.exam_id and (scope_id is null or scope_id = q.subject_id) where enabled
), links as (
    select question_id, exam_id, link_type, relevance, association_id from every
    qualify row_number() over (partition by question_id, exam_id order by coalesce(association_id, 0)) = 1
)"""


def _count(condition: str, name: str):
    return F.count_if(F.expr(condition)).alias(name)


@query(f"""with {QUESTIONS}, {OPTIONS}, answered as (select distinct question_id from options where is_correct)
select subject_id, subject_name, count(*) as total,
    count(*) filter (quality = 'pass') as passed, count(*) filter (quality = 'review') as in_review, count(*) filter (quality = 'failed') as failed,
    count(*) filter (difficulty = 'easy') as easy, count(*) filter (difficulty = 'medium') as medium, count(*) filter (difficulty = 'hard') as hard,
    count(answered.question_id) as answered, count(*) filter (quality = 'pass' and answered.question_id is not null) as deliverable,
    count(*) filter (confidence < 0.7) as low_confidence, count(*) filter (year >= 1997) as recent
from questions left join answered using (question_id) group by all""")
def warehouse_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the questions with ten filtered counts per subject."""
    answered = options(spark, sf_dir).where("is_correct").select("question_id", F.lit(True).alias("answered")).distinct()
    q = questions(spark, sf_dir).join(answered, "question_id", "left")
    return q.groupBy("subject_id", "subject_name").agg(
        F.count("*").alias("total"),
        _count("quality = 'pass'", "passed"), _count("quality = 'review'", "in_review"), _count("quality = 'failed'", "failed"),
        _count("difficulty = 'easy'", "easy"), _count("difficulty = 'medium'", "medium"), _count("difficulty = 'hard'", "hard"),
        _count("answered", "answered"), _count("quality = 'pass' and answered", "deliverable"),
        _count("confidence < 0.7", "low_confidence"), _count("year >= 1997", "recent"),
    )


@query(f"""with {QUESTIONS} select subject_id, topic, count(*) as total, count(*) filter (quality = 'pass') as passed from questions group by all""")
def warehouse_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by subject and topic."""
    return questions(spark, sf_dir).groupBy("subject_id", "topic").agg(F.count("*").alias("total"), _count("quality = 'pass'", "passed"))


@query(f"""with {_LINKS} select r_name as exam_name, subject_id, link_type, quality, count(*) as n
from links join questions using (question_id) join region on links.exam_id = r_regionkey + 1 group by all""")
def warehouse_exam_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each exam reaches, by subject, kind of link and verdict."""
    q = questions(spark, sf_dir)
    links = all_links(q, associations(spark))
    met = links.join(q.drop("exam_id"), "question_id").join(exams(spark, sf_dir), "exam_id")
    return met.groupBy("exam_name", "subject_id", "link_type", "quality").agg(F.count("*").alias("n"))


@query(f"""with {QUESTIONS} select subject_id, count(*) as orphans from questions q
where not exists (select 1 from lineitem where l_orderkey = question_id) group by all""")
def warehouse_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without any child row, by an anti join."""
    return questions(spark, sf_dir).join(table(spark, sf_dir, "lineitem"), F.col("question_id") == F.col("l_orderkey"), "left_anti").groupBy("subject_id").agg(F.count("*").alias("orphans"))


@query(f"""with {QUESTIONS}, hits as (
    select question_id, subject_id, difficulty, quality, confidence from questions
    where quality = 'pass' and difficulty = 'hard' and contains(lower(subject_name), 'n') and question_id in (select l_orderkey from lineitem where l_returnflag = 'R')
)
select question_id, subject_id, difficulty, quality, confidence, (select count(*) from hits) as total, cast(ceil((select count(*) from hits) / 50.0) as bigint) as pages
from hits order by confidence desc, question_id limit 50 offset 50""")
def warehouse_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 of a filtered list, with its total and number of pages."""
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question_id"))
    hits = questions(spark, sf_dir).where("quality = 'pass' and difficulty = 'hard' and contains(lower(subject_name), 'n')").join(flagged, "question_id", "left_semi")
    page = hits.orderBy(F.desc("confidence"), "question_id").offset(50).limit(50).select("question_id", "subject_id", "difficulty", "quality", "confidence")
    return page.crossJoin(hits.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 50).alias("pages")))


@query(f"""with {_LINKS} select question_id, list(r_name || ':' || link_type order by link_type desc, r_name) as tags
from links join region on exam_id = r_regionkey + 1 group by question_id""")
def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exams that reach each question, direct ones first."""
    links = all_links(questions(spark, sf_dir), associations(spark)).join(exams(spark, sf_dir), "exam_id")
    tag = F.struct((F.col("link_type") != "direct").alias("after"), "exam_name", F.concat_ws(":", "exam_name", "link_type").alias("tag"))
    return links.groupBy("question_id").agg(F.sort_array(F.collect_list(tag))["tag"].alias("tags"))


@query(f"""with {_LINKS} select question_id, exam_id, link_type, relevance from every where link_type = 'direct'""")
def links_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question and its own exam."""
    return direct_links(questions(spark, sf_dir)).drop("association_id")


@query(f"""with {_LINKS} select question_id, exam_id, link_type, relevance, association_id from every where link_type = 'associated'""")
def links_associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exams borrow, by association."""
    return associated_links(questions(spark, sf_dir), associations(spark))


@query(f"""with {_LINKS} select question_id, exam_id, link_type, relevance, association_id from links""")
def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link for each question and exam."""
    return all_links(questions(spark, sf_dir), associations(spark))


@query(f"""with {_LINKS}, held as (select * from links where question_id % 7 <> 0)
select exam_id, count(*) as missing, count(*) filter (link_type = 'direct') as direct from links anti join held using (question_id, exam_id) group by all""")
def links_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that an incremental run would add, here to a table that lost every seventh question's."""
    links = all_links(questions(spark, sf_dir), associations(spark))
    held = links.where("question_id % 7 <> 0").select("question_id", "exam_id")
    return links.join(held, ["question_id", "exam_id"], "left_anti").groupBy("exam_id").agg(F.count("*").alias("missing"), _count("link_type = 'direct'", "direct"))


_RANK = "case quality when 'failed' then 0 when 'review' then 1 when 'unchecked' then 2 else 3 end"


@query(f"""with {QUESTIONS} select question_id, quality, confidence, subject_id from questions where quality <> 'pass'
order by {_RANK}, confidence, question_id limit 200""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of the review queue, worst verdict and least confidence first."""
    return questions(spark, sf_dir).where("quality <> 'pass'").orderBy(F.expr(_RANK), "confidence", "question_id").limit(200).select("question_id", "quality", "confidence", "subject_id")


@query(f"""with {QUESTIONS} select quality, count(*) as n, round(avg(confidence), 6) as mean_confidence from questions group by all""")
def review_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank by verdict."""
    return questions(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""with {QUESTIONS} select subject_name, count(*) filter (quality = 'review') as in_review, count(*) filter (quality = 'failed') as failed
from questions where quality <> 'pass' group by all""")
def review_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for review, by subject."""
    return questions(spark, sf_dir).where("quality <> 'pass'").groupBy("subject_name").agg(_count("quality = 'review'", "in_review"), _count("quality = 'failed'", "failed"))


@query("""select count(*) as documents, (select count(*) from orders) as questions, (select count(*) from orders where o_orderstatus = 'F') as passed,
    (select count(*) from lineitem) as options, (select count(*) from region) as exams, (select count(*) from nation) as subjects,
    (select count(*) from events) as jobs, (select count(*) from events where event_type = 'error') as failed_jobs from customer""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's counts, one aggregate row for each table."""
    counts = [
        table(spark, sf_dir, "customer").agg(F.count("*").alias("documents")),
        table(spark, sf_dir, "orders").agg(F.count("*").alias("questions"), _count("o_orderstatus = 'F'", "passed")),
        table(spark, sf_dir, "lineitem").agg(F.count("*").alias("options")),
        table(spark, sf_dir, "region").agg(F.count("*").alias("exams")),
        table(spark, sf_dir, "nation").agg(F.count("*").alias("subjects")),
        table(spark, sf_dir, "events").agg(F.count("*").alias("jobs"), _count("event_type = 'error'", "failed_jobs")),
    ]
    out = counts[0]
    for one_row in counts[1:]:
        out = out.crossJoin(one_row)
    return out


@query(f"""with {_LINKS} select r_regionkey + 1 as exam_id, r_name as exam_name, (select count(*) from nation where n_regionkey = r_regionkey) as subjects,
    coalesce(n, 0) as reachable, coalesce(own, 0) as own, coalesce(n - own, 0) as borrowed
from region left join (select exam_id, count(*) as n, count(*) filter (link_type = 'direct') as own from links group by all) l on l.exam_id = r_regionkey + 1""")
def exam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exam's subjects and reachable questions, its own and borrowed, by grouped left joins."""
    links = all_links(questions(spark, sf_dir), associations(spark)).groupBy("exam_id").agg(F.count("*").alias("n"), _count("link_type = 'direct'", "o"))
    held = subjects(spark, sf_dir).groupBy("exam_id").agg(F.count("*").alias("s"))
    out = exams(spark, sf_dir).join(held, "exam_id", "left").join(links, "exam_id", "left").na.fill(0)
    return out.select("exam_id", "exam_name", F.col("s").alias("subjects"), F.col("n").alias("reachable"), F.col("o").alias("own"), (F.col("n") - F.col("o")).alias("borrowed"))


@query(f"""with {QUESTIONS} select n_nationkey + 1 as subject_id, n_name as subject_name, coalesce(q.n, 0) as questions, coalesce(d.n, 0) as documents, coalesce(s.n, 0) as suppliers, coalesce(t.n, 0) as topics
from nation left join (select subject_id, count(*) as n from questions group by all) q on q.subject_id = n_nationkey + 1
left join (select c_nationkey, count(*) as n from customer group by all) d on d.c_nationkey = n_nationkey
left join (select s_nationkey, count(*) as n from supplier group by all) s on s.s_nationkey = n_nationkey
left join (select subject_id, count(distinct topic) as n from questions group by all) t on t.subject_id = n_nationkey + 1""")
def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with four counts each."""
    q = questions(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("questions"), F.count_distinct("topic").alias("topics"))
    d = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).alias("subject_id")).agg(F.count("*").alias("documents"))
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 1).alias("subject_id")).agg(F.count("*").alias("suppliers"))
    out = subjects(spark, sf_dir).drop("exam_id").join(q, "subject_id", "left").join(d, "subject_id", "left").join(s, "subject_id", "left")
    return out.na.fill(0).select("subject_id", "subject_name", "questions", "documents", "suppliers", "topics")


@query("""with own as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
marked as (select doc_id, lines, cast(doc_id % len(lines) as bigint) + 1 as first from own)
select doc_id, first as first_line, len(lines) as n_lines, md5(array_to_string(lines[greatest(1, first - 3):first + 4], chr(10))) as window_md5 from marked""")
def provenance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source lines around a question that was read from two lines of a document, three more on either side."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).withColumn("first_line", (F.col("doc_id") % F.size("lines") + 1))
    begin = F.greatest(F.lit(1), F.col("first_line") - 3).cast("int")
    window = F.slice("lines", begin, (F.col("first_line") + 5).cast("int") - begin)
    return d.select("doc_id", "first_line", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(window, "\n").cast("binary")).alias("window_md5"))
