"""Pattern inference over orders as papers and part types as their sections (A series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators import patterns as A
from examlake.plans.model import QUESTIONS, questions, table
from examlake.registry import query

_OBSERVED = f"""{QUESTIONS}, observed as (
    select exam_id, l_orderkey as paper_id, p_type as section, count(*) as n, min(l_linenumber) as place
    from lineitem join part on l_partkey = p_partkey join questions on question_id = l_orderkey group by all
), papers as (select exam_id, count(distinct paper_id) as papers from observed group by exam_id),
g as (
    select exam_id, section, cast(round(median(n)) as bigint) as questions, count(*) as seen, avg(n) as mean, stddev_pop(n) as deviation,
        cast(round(avg(place)) as bigint) as mean_place, min(paper_id) as first_seen from observed group by all
), a as (
    select *, round(case when seen = 1 then seen / papers * 0.6 else seen / papers * (0.5 + 0.5 * greatest(0.0, 1 - deviation / mean)) end, 2) as agreement,
        row_number() over (partition by exam_id order by mean_place, first_seen, section) - 1 as order_index, questions / sum(questions) over (partition by exam_id) * 100 as share
    from g join papers using (exam_id) where questions > 0
), drafts as (
    select exam_id, section, questions, seen, agreement, cast(order_index as int) as order_index,
        round(share + case when row_number() over (partition by exam_id order by questions desc, order_index) = 1 then 100 - sum(share) over (partition by exam_id) else 0 end, 6) as weightage from a
)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exam_id, paper_id, section, n, place``: sections of each paper."""
    q = questions(spark, sf_dir).select("question_id", "exam_id")
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(q, F.col("l_orderkey") == F.col("question_id"))
    return met.groupBy("exam_id", F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("section")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("place"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sections(observed(spark, sf_dir), "exam_id", "paper_id", "section", "n", "place")


@query(f"with {_OBSERVED} select exam_id, section, questions, seen, agreement, order_index, weightage from drafts")
def pattern_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that an exam's papers agree on."""
    return drafts(spark, sf_dir)


@query(f"""with {_OBSERVED}, c as (select exam_id, n, count(*) as seen from observed group by all)
select exam_id, n as mode, seen from c qualify row_number() over (partition by exam_id order by seen desc, n desc) = 1""")
def pattern_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent section size of each exam, the larger of equals."""
    return A.mode_larger_wins(observed(spark, sf_dir), ["exam_id"], "n")


@query(f"""with {_OBSERVED}, s as (select exam_id, sum(agreement * questions) / sum(questions) as section_score, count(*) filter (section in ('PROMO', 'LARGE')) / count(*) as unmatched from drafts group by exam_id),
totals as (select exam_id, paper_id, sum(n) as total from observed group by all), t as (select exam_id, count(*) as papers, avg(total) as mean, stddev_pop(total) as deviation from totals group by exam_id)
select exam_id, round(greatest(0.05, least(0.99, (0.55 * section_score + 0.25 * case when papers > 1 then greatest(0.0, 1 - deviation / mean) else 1.0 end + 0.20 * least(1.0, 0.45 + 0.14 * papers)) * (1 - 0.35 * unmatched))), 2) as confidence from s join t using (exam_id)""")
def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each exam's pattern can be trusted; two part types stand for sections without a subject."""
    totals = observed(spark, sf_dir).groupBy("exam_id", "paper_id").agg(F.sum("n").alias("total"))
    return A.confidence(drafts(spark, sf_dir), totals, "exam_id", "total", ~F.col("section").isin("PROMO", "LARGE"))


@query(f"""with {_OBSERVED}, totals as (select exam_id, paper_id, sum(n) as total from observed group by all), m as (select exam_id, median(total) as usual from totals group by exam_id)
select exam_id, count(*) filter (3 * abs(total - usual) > usual) as outliers, count(*) as papers from totals join m using (exam_id) group by exam_id""")
def pattern_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose total lies more than a third off the usual one."""
    totals = observed(spark, sf_dir).groupBy("exam_id", "paper_id").agg(F.sum("n").alias("total"))
    usual = totals.groupBy("exam_id").agg(F.median("total").alias("usual"))
    return totals.join(usual, "exam_id").groupBy("exam_id").agg(F.count_if(3 * F.abs(F.col("total") - F.col("usual")) > F.col("usual")).alias("outliers"), F.count("*").alias("papers"))


@query("""select c_nationkey + 1 as subject_id, coalesce(max(version), 0) + 1 as next_version, count(*) as kept from (
    select c_nationkey, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as version from customer) group by c_nationkey""")
def pattern_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of each subject's patterns."""
    from pyspark.sql import Window

    version = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", version.alias("version"))
    return rows.groupBy((F.col("c_nationkey") + 1).alias("subject_id")).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("long").alias("next_version"), F.count("*").alias("kept"))


# Papers with printed headers: every thirteenth order yields no questions, and of some the header leaves something out.
_HEADED = """headed as (
    select exam_id, o_orderkey as paper_id, case when o_orderkey % 13 > 0 then n end as questions, cast(o_orderkey % 3 + 3 as int) as options, [60, 90, 120, 150][o_orderkey % 4 + 1] as minutes, case when o_orderkey % 7 > 0 then 100.0 * (o_orderkey % 3 + 1) end as total,
        1.0 * (o_orderkey % 2 + 1) as each, case when o_orderkey % 5 = 0 then 0.0 else round(1.0 / (o_orderkey % 4 + 2), 2) end as penalty
    from orders join (select paper_id, exam_id, sum(n) as n from observed group by all) on paper_id = o_orderkey
), usable as (select * from headed where questions > 0)"""


def headed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exam_id, paper_id, text, questions, options``: orders as papers whose first lines state time, marks and penalty."""
    key = F.col("paper_id")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    minutes = F.element_at(F.array(*map(F.lit, (60, 90, 120, 150))), (key % 4 + 1).cast("int"))
    lines = F.array(
        say("Paper ", key), say("Time allowed: ", minutes, " minutes"), F.when(key % 7 > 0, say("Maximum Marks: ", 100 * (key % 3 + 1))), say("Each question carries ", key % 2 + 1, " marks."),
        F.when(key % 5 == 0, "There is no negative marking.").otherwise(say("Negative marking: 1/", key % 4 + 2, " for a wrong answer")),
    )
    papers = observed(spark, sf_dir).groupBy("exam_id", "paper_id").agg(F.sum("n").alias("n"))
    return papers.select("exam_id", "paper_id", F.array_join(lines, "\n\n").alias("text"), F.when(key % 13 > 0, F.col("n")).alias("questions"), (key % 3 + 3).cast("int").alias("options"))


def _mode(column: str, name: str) -> str:
    return f"{name} as (select exam_id, {column} as v from (select exam_id, {column}, count(*) as c from usable where {column} is not null group by all) qualify row_number() over (partition by exam_id order by c desc, {column} desc) = 1)"


_SCHEMES = ", ".join(_mode(c, n) for c, n in (("minutes", "md"), ("total", "mt"), ("each", "me"), ("penalty", "mp"), ("options", "mo")))


@query(f"""with {_OBSERVED}, {_HEADED}, {_SCHEMES} select exam_id, cast(md.v as int) as duration_min, cast(mt.v as double) as total_marks, cast(me.v as double) as marks_per_question, cast(mp.v as double) as negative_marks
from md left join mt using (exam_id) left join me using (exam_id) left join mp using (exam_id)""")
def pattern_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, marks and penalty that the headers of an exam's papers agree on."""
    return A.schemes(headed_papers(spark, sf_dir).where("questions > 0"), "exam_id", "text")


@query(f"""with {_OBSERVED}, {_HEADED}, {_SCHEMES},
o2 as (select * from observed where paper_id % 13 > 0), p2 as (select exam_id, count(distinct paper_id) as papers from o2 group by exam_id),
g2 as (select exam_id, section, cast(round(median(n)) as bigint) as questions, count(*) as seen, avg(n) as mean, stddev_pop(n) as deviation from o2 group by all),
a2 as (select *, round(case when seen = 1 then seen / papers * 0.6 else seen / papers * (0.5 + 0.5 * greatest(0.0, 1 - deviation / mean)) end, 2) as agreement from g2 join p2 using (exam_id) where questions > 0),
s2 as (select exam_id, sum(agreement * questions) / sum(questions) as section_score, cast(sum(questions) as bigint) as section_total, count(*) as sections from a2 group by exam_id),
t2 as (select exam_id, count(*) as papers, avg(questions) as mean, stddev_pop(questions) as deviation from usable group by exam_id),
b2 as (select exam_id, count(*) filter (questions > 0) as derived_from, count(*) filter (questions is null) as skipped from headed group by exam_id)
select exam_id, derived_from, skipped, section_total as total_questions, cast(mo.v as int) as options, cast(md.v as int) as duration_min, cast(me.v as double) as marks_per_question, cast(mp.v as double) as negative_marks, cast(mt.v as double) as total_marks, sections,
    round(greatest(0.05, least(0.99, 0.55 * section_score + 0.25 * case when t2.papers > 1 then greatest(0.0, 1 - deviation / mean) else 1.0 end + 0.20 * least(1.0, 0.45 + 0.14 * t2.papers))), 2) as confidence
from b2 join s2 using (exam_id) join t2 using (exam_id) join md using (exam_id) join mt using (exam_id) join me using (exam_id) join mp using (exam_id) join mo using (exam_id)""")
def pattern_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exam's pattern from the papers that yield questions."""
    found = A.draft(headed_papers(spark, sf_dir), observed(spark, sf_dir), "exam_id", "paper_id", "section", "n", "place")
    return found.select("exam_id", "derived_from", "skipped", "total_questions", "options", "duration_min", "marks_per_question", "negative_marks", "total_marks", "sections", "confidence")
