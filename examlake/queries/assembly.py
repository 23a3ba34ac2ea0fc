"""Paper assembly over the bank (B series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators import assembly as B
from examlake.operators.links import all_links
from examlake.plans.model import OPTIONS, associations, exams, options, questions, subjects
from examlake.queries.warehouse import _LINKS
from examlake.registry import query

SEED = 7
#: Percent of easy and hard questions; medium takes the rest.
EASY, HARD = 30, 25

_POOL = f"""{_LINKS}, {OPTIONS}, answered as (select distinct question_id from options where is_correct),
pool as (
    select q.question_id, q.subject_id, q.difficulty, q.seconds, q.year, l.exam_id, l.link_type, l.relevance from questions q join links l using (question_id)
    where quality = 'pass' and question_id in (select question_id from answered)
), sections as (
    select exam_id, subject_id, row_number() over (partition by exam_id order by subject_id) as place, 5 + subject_id % 4 as pattern_count
    from (select n_regionkey + 1 as exam_id, n_nationkey + 1 as subject_id from nation)
), shares as (
    select *, sum(pattern_count) over (partition by exam_id) as total, lead(1) over (partition by exam_id order by place) is null as is_last from sections
), parts as (select *, greatest(1, cast(round(pattern_count / total * 100) as bigint)) as part from shares),
quotas as (
    select exam_id, subject_id, place, cast(case when is_last then greatest(0, 100 - coalesce(sum(part) over (partition by exam_id order by place rows between unbounded preceding and 1 preceding), 0)) else part end as bigint) as want from parts
)"""

_CHOSEN = f"""{_POOL}, targets as (select *, want * {EASY} // 100 as t_easy, want * {HARD} // 100 as t_hard, want - want * {EASY} // 100 - want * {HARD} // 100 as t_medium from quotas),
ranked as (
    select p.*, t.want, row_number() over (partition by p.exam_id, p.subject_id, difficulty order by relevance desc, md5('{SEED}:' || question_id), question_id) as rnk,
        case difficulty when 'easy' then t_easy when 'hard' then t_hard else t_medium end as target
    from pool p join targets t on p.exam_id = t.exam_id and p.subject_id = t.subject_id
), phased as (
    select *, case when rnk > target then rnk - target end as turn, case when rnk > target then 3 when difficulty = 'easy' then 0 when difficulty = 'medium' then 1 else 2 end as phase from ranked
), numbered as (
    select *, row_number() over (partition by exam_id, subject_id order by phase, coalesce(turn, 0), case when turn is null then 0 when difficulty = 'medium' then 0 when difficulty = 'easy' then 1 else 2 end, rnk) as sequence from phased
), chosen as (select exam_id, subject_id, question_id, difficulty, relevance, cast(phase as int) as phase, cast(sequence as int) as sequence from numbered where sequence <= want)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    answered = options(spark, sf_dir).where("is_correct").select("question_id").distinct()
    return B.candidates(q, all_links(q, associations(spark)), answered)


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subjects(spark, sf_dir).select("exam_id", "subject_id", (F.lit(5) + F.col("subject_id") % 4).cast("long").alias("pattern_count"), F.lit(100).cast("long").alias("target"))
    return B.scaled(s, "exam_id", "subject_id", "pattern_count", "target").select("exam_id", "subject_id", "want")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotas(spark, sf_dir).select("*", F.lit(EASY).alias("easy"), F.lit(100 - EASY - HARD).alias("medium"), F.lit(HARD).alias("hard"))
    return B.selected(pool(spark, sf_dir), q, ["exam_id", "subject_id"], SEED)


@query(f"with {_POOL} select exam_id, subject_id, want from quotas")
def assembly_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exam's sections scaled to a hundred questions."""
    return quotas(spark, sf_dir)


@query(f"with {_POOL} select exam_id, question_id, subject_id, difficulty, link_type, relevance from pool")
def assembly_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each exam may draw from, behind the quality gate."""
    return pool(spark, sf_dir).select("exam_id", "question_id", "subject_id", "difficulty", "link_type", "relevance")


@query(f"with {_CHOSEN} select exam_id, subject_id, question_id, difficulty, relevance, phase, sequence from chosen")
def assembly_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of every section, chosen and numbered."""
    return chosen(spark, sf_dir)


@query(f"""with {_LINKS}, {OPTIONS}, answered as (select distinct question_id from options where is_correct)
select l.exam_id, subject_id, count(*) filter (link_type = 'direct') as own, count(*) filter (link_type <> 'direct') as borrowed, count(a.question_id) as answered,
    count(*) filter (quality = 'pass') as passed, count(*) filter (quality = 'pass' and a.question_id is not null) as deliverable, count(*) filter (quality <> 'pass') as held
from links l join questions q using (question_id) left join answered a using (question_id) group by all""")
def assembly_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply of every exam and subject by one aggregation."""
    q = questions(spark, sf_dir)
    answered = options(spark, sf_dir).where("is_correct").select("question_id", F.lit(True).alias("answered")).distinct()
    met = all_links(q, associations(spark)).join(q.drop("exam_id"), "question_id").join(answered, "question_id", "left")
    count = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return met.groupBy("exam_id", "subject_id").agg(
        count("link_type = 'direct'", "own"), count("link_type <> 'direct'", "borrowed"), count("answered", "answered"), count("quality = 'pass'", "passed"),
        count("quality = 'pass' and answered", "deliverable"), count("quality <> 'pass'", "held"),
    )


@query(f"""with {_CHOSEN}, f as (
    select quotas.exam_id, quotas.subject_id, want, count(question_id) as filled, count(*) filter (difficulty = 'easy') as easy, count(*) filter (difficulty = 'medium') as medium, count(*) filter (difficulty = 'hard') as hard
    from quotas left join chosen on quotas.exam_id = chosen.exam_id and quotas.subject_id = chosen.subject_id group by all
)
select exam_id, subject_id, want, filled, want - filled as short, case when want = filled then 'filled' when filled = 0 then 'nothing reachable' else 'too few answered' end as reason, easy, medium, hard from f""")
def assembly_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill, shortfall and difficulty spread of every section."""
    met = quotas(spark, sf_dir).join(chosen(spark, sf_dir), ["exam_id", "subject_id"], "left")
    count = lambda c: F.count_if(F.col("difficulty") == c).alias(c)
    out = met.groupBy("exam_id", "subject_id", "want").agg(F.count("question_id").alias("filled"), count("easy"), count("medium"), count("hard"))
    reason = F.when(F.col("want") == F.col("filled"), "filled").when(F.col("filled") == 0, "nothing reachable").otherwise("too few answered")
    return out.select("exam_id", "subject_id", "want", "filled", (F.col("want") - F.col("filled")).alias("short"), reason.alias("reason"), "easy", "medium", "hard")


@query(f"""with {_POOL} select pool.exam_id, r_name as owner, count(*) as n from pool join questions q using (question_id)
left join region on q.exam_id = r_regionkey + 1 where link_type = 'associated' group by all""")
def assembly_borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose questions each exam may borrow."""
    owners = questions(spark, sf_dir).select("question_id", F.col("exam_id").alias("owner_id"))
    met = pool(spark, sf_dir).where("link_type = 'associated'").join(owners, "question_id")
    named = met.join(exams(spark, sf_dir).withColumnRenamed("exam_id", "owner_id"), "owner_id", "left")
    return named.groupBy("exam_id", F.col("exam_name").alias("owner")).agg(F.count("*").alias("n"))


@query(f"""with {_CHOSEN} select exam_id, cast(ceil(sum(seconds) / 60.0) as bigint) as minutes, count(*) as questions, min(year) as first_year, max(year) as last_year
from chosen join (select question_id, seconds, year from questions) using (question_id) group by exam_id""")
def assembly_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each paper from its questions' estimated seconds."""
    q = questions(spark, sf_dir).select("question_id", "seconds", "year")
    return chosen(spark, sf_dir).join(q, "question_id").groupBy("exam_id").agg(F.ceil(F.sum("seconds") / F.lit(60.0)).alias("minutes"), F.count("*").alias("questions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query(f"""with {_CHOSEN}, used as (select distinct question_id from chosen where exam_id <= 2)
select exam_id, count(*) as left_over from pool anti join used using (question_id) group by all""")
def assembly_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left when the questions of the first two exams' papers are excluded."""
    used = chosen(spark, sf_dir).where("exam_id <= 2").select("question_id").distinct()
    return pool(spark, sf_dir).join(used, "question_id", "left_anti").groupBy("exam_id").agg(F.count("*").alias("left_over"))


# Patterns of three sections, of which the first and the last share a subject; exams are papers, and what a question lacks in marks the pattern gives.
_SHARED = f"""{_POOL}, firsts as (select exam_id, min(subject_id) as s1, max(subject_id) as s2 from quotas group by exam_id),
plan as (
    select exam_id, k as section, case when k = 2 then s2 else s1 end as subject_id, cast([9, 6, 14][k] as bigint) as want, [0, 60, 30][k] as e, [0, 30, 45][k] as m, [0, 30, 10][k] as h, [0, 2, -1][k] as marks, exam_id % 3 as pattern_marks
    from firsts, (select unnest([1, 2, 3]) as k)
), mixed as (
    select *, case when e + m + h = 0 then 30 when e + m + h = 100 then e else e * 100 // (e + m + h) end as easy, case when e + m + h = 0 then 50 when e + m + h = 100 then m else m * 100 // (e + m + h) end as medium from plan
), plan_targets as (select *, want * easy // 100 as t_easy, want * (100 - easy - medium) // 100 as t_hard, want - want * easy // 100 - want * (100 - easy - medium) // 100 as t_medium from mixed)"""


def _round(number: int) -> str:
    """One section of every exam from what the sections before have left."""
    used = " union all ".join(f"select exam_id, question_id from drawn{i}" for i in range(1, number)) or "select 0 :: bigint as exam_id, 0 :: bigint as question_id where false"
    return f"""left{number} as (select p.* from pool p anti join ({used}) u on u.exam_id = p.exam_id and u.question_id = p.question_id),
ranked{number} as (
    select p.exam_id, t.section, t.want, p.question_id, p.difficulty, p.relevance, row_number() over (partition by p.exam_id, difficulty order by relevance desc, md5('{SEED}:' || question_id), question_id) as rnk,
        case difficulty when 'easy' then t_easy when 'hard' then t_hard else t_medium end as target
    from left{number} p join plan_targets t on p.exam_id = t.exam_id and p.subject_id = t.subject_id where t.section = {number}
), order{number} as (
    select *, row_number() over (partition by exam_id order by case when rnk > target then 3 when difficulty = 'easy' then 0 when difficulty = 'medium' then 1 else 2 end, greatest(rnk - target, 0),
        case when rnk <= target then 0 when difficulty = 'medium' then 0 when difficulty = 'easy' then 1 else 2 end, rnk) as sequence from ranked{number}
), drawn{number} as (select exam_id, section, question_id, difficulty, sequence from order{number} where sequence <= want)"""


_BUILT = f"{_SHARED}, {_round(1)}, {_round(2)}, {_round(3)}, drawn as (select * from drawn1 union all select * from drawn2 union all select * from drawn3)"


def shared_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = quotas(spark, sf_dir).groupBy("exam_id").agg(F.min("subject_id").alias("s1"), F.max("subject_id").alias("s2"))
    pick = lambda *v: F.element_at(F.array(*(F.lit(x).cast("long") for x in v)), F.col("section"))
    plan = firsts.select("exam_id", "s1", "s2", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("section"))
    mix = B.normalised_mix(pick(0, 60, 30), pick(0, 30, 45), pick(0, 30, 10))
    return plan.select("exam_id", "section", F.when(F.col("section") == 2, F.col("s2")).otherwise(F.col("s1")).alias("subject_id"), pick(9, 6, 14).alias("want"), mix.alias("mix"), B.marks(pick(0, 2, -1), F.col("exam_id") % 3, F.lit(1)).cast("long").alias("marks")).select("*", "mix.*").drop("mix")


@query(f"""with {_BUILT} select d.exam_id, d.section, question_id, d.difficulty, cast(row_number() over (partition by d.exam_id order by d.section, sequence) as int) as item,
    cast(case when p.marks > 0 then p.marks when pattern_marks > 0 then pattern_marks else 1 end as bigint) as marks from drawn d join plan p on d.exam_id = p.exam_id and d.section = p.section""")
def assembly_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole papers whose first and last section draw from one subject, no question twice, with each item's marks."""
    plan = shared_plan(spark, sf_dir)
    items, _ = B.built(pool(spark, sf_dir), plan, "exam_id", SEED, 3)
    return items.join(plan.select("exam_id", "section", "marks"), ["exam_id", "section"]).select("exam_id", "section", "question_id", "difficulty", "item", "marks")


@query(f"""with {_BUILT}, a as (select exam_id, section, count(*) as available from (select exam_id, section from ranked1 union all select exam_id, section from ranked2 union all select exam_id, section from ranked3) group by all),
f as (select exam_id, section, count(*) as filled from drawn group by all)
select p.exam_id, p.section, p.want, coalesce(filled, 0) as filled, coalesce(available, 0) as available, p.want - coalesce(filled, 0) as short,
    case when coalesce(filled, 0) >= p.want then 'filled' when coalesce(available, 0) = 0 then 'nothing reachable' else 'too few answered' end as reason
from plan p left join a on a.exam_id = p.exam_id and a.section = p.section left join f on f.exam_id = p.exam_id and f.section = p.section""")
def assembly_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each section of those papers was filled from what the sections before had left."""
    _, fill = B.built(pool(spark, sf_dir), shared_plan(spark, sf_dir), "exam_id", SEED, 3)
    return fill
