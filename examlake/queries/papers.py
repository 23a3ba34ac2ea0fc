"""Paper-level rules over the assembled papers and over orders as papers (W series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators import paper_rules as W
from examlake.plans.model import OPTIONS, options, questions, table
from examlake.queries.assembly import _CHOSEN, chosen, quotas
from examlake.registry import query


@query(f"""with {_CHOSEN}, found as (select exam_id, subject_id, count(*) as found from chosen group by all),
j as (select coalesce(q.exam_id, f.exam_id) as exam_id, coalesce(q.subject_id, f.subject_id) as subject_id, coalesce(want, 0) as want, coalesce(found, 0) as found
    from quotas q full join found f on q.exam_id = f.exam_id and q.subject_id = f.subject_id)
select exam_id, subject_id, want, found, case when want > 0 and found = 0 then 'paper_section_missing' when want <> found then 'paper_section_count_mismatch' end as code,
    case when want <> found then case when found = 0 or want - found > 2 or found > want then 'critical' else 'major' end end as severity from j""")
def paper_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each paper against the pattern, two missing questions tolerated."""
    return W.section_counts(quotas(spark, sf_dir), chosen(spark, sf_dir), ["exam_id", "subject_id"], tolerance=2)


@query("""select l_orderkey as paper_id, count(*) as items, round(sum(l_quantity), 2) as marks, round(o_totalprice, 2) as header_marks, abs(sum(l_quantity) - o_totalprice) > 0.01 as marks_differ,
    count(distinct l_discount) as penalties, count(distinct l_discount) > 1 as penalties_differ from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_totalprice""")
def paper_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against summed marks, and whether penalties are uniform, with orders as papers."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = met.groupBy(F.col("l_orderkey").alias("paper_id"), "o_totalprice").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("m"), F.count_distinct("l_discount").alias("penalties"))
    return out.select("paper_id", "items", F.round("m", 2).alias("marks"), F.round("o_totalprice", 2).alias("header_marks"), (F.abs(F.col("m") - F.col("o_totalprice")) > 0.01).alias("marks_differ"), "penalties", (F.col("penalties") > 1).alias("penalties_differ"))


@query("""with i as (select l_orderkey as paper_id, l_linenumber as sequence, l_partkey as question_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from lineitem)
select paper_id, place, question_id, first from (select *, first_value(place) over w as first, row_number() over w as turn from i window w as (partition by paper_id, question_id order by place)) where turn > 1""")
def paper_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that stand twice in one paper."""
    return W.repeated(_items(spark, sf_dir), "paper_id", F.col("question_id"), "place").select("paper_id", "place", "question_id", "first")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("question_id"), place.alias("place"))


@query("""with i as (select l_orderkey as paper_id, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from lineitem),
s as (select paper_id, place, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as key from i join part on l_partkey = p_partkey)
select paper_id, place, first from (select *, first_value(place) over w as first, row_number() over w as turn from s window w as (partition by paper_id, key order by place)) where turn > 1""")
def paper_repeated_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items worded like an earlier one of the same paper."""
    named = _items(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("question_id") == F.col("p_partkey"))
    return W.repeated(named, "paper_id", W.stem_key(F.col("p_name"), F.lit(None)), "place").select("paper_id", "place", "first")


@query(f"""with {_CHOSEN}, single as (select question_id, min(position) as position from options where is_correct group by question_id having count(*) = 1),
per as (select exam_id, position, count(*) as n from chosen join single using (question_id) group by all),
t as (select exam_id, cast(sum(n) as bigint) as answered, count(*) as positions, max(n) as top from per group by exam_id)
select exam_id, answered, positions, cast(top * 100 // answered as bigint) as top_share,
    answered >= 20 and (positions < 2 or top * 100 // answered > 2 * (100 // positions) or (positions >= 4 and top * 100 // answered > 45)) as skewed from t""")
def paper_key_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether right answers crowd one position of a paper."""
    single = options(spark, sf_dir).where("is_correct").groupBy("question_id").agg(F.min("position").alias("position"), F.count("*").alias("n")).where("n = 1").drop("n")
    return W.key_skew(chosen(spark, sf_dir).join(single, "question_id"), "exam_id", "position")


@query("""with i as (select l_orderkey as paper_id, l_linenumber as number, row_number() over (partition by l_orderkey order by l_linenumber) as place from lineitem)
select paper_id, cast(min(place) as int) as place, min_by(number, place) as number from i where number <> place group by paper_id""")
def paper_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first jump in each paper's numbering."""
    return W.sequence_gaps(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "paper_id"), "paper_id", "l_linenumber")


@query("""select l_orderkey as paper_id, l_returnflag as section, count(distinct p_type) as subjects, list(distinct p_type order by p_type) as names
from lineitem join part on l_partkey = p_partkey group by all having count(distinct p_type) > 1""")
def paper_subject_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that mix subjects."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = met.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("section")).agg(F.sort_array(F.collect_set("p_type")).alias("names"))
    return out.where("size(names) > 1").select("paper_id", "section", F.size("names").cast("long").alias("subjects"), "names")


@query(f"""with {_CHOSEN}, s as (select exam_id, count(*) filter (difficulty = 'easy') * 100 // count(*) as easy, count(*) filter (difficulty = 'medium') * 100 // count(*) as medium, count(*) filter (difficulty = 'hard') * 100 // count(*) as hard from chosen group by exam_id)
select exam_id, cast(easy as bigint) as easy, cast(medium as bigint) as medium, cast(hard as bigint) as hard, abs(easy - 30) > 15 or abs(medium - 45) > 15 or abs(hard - 25) > 15 as off from s""")
def paper_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's difficulty in whole percent against the requested mix, fifteen points tolerated."""
    share = lambda x: F.expr(f"count_if(difficulty = '{x}') * 100 div count(*)").alias(x)
    s = chosen(spark, sf_dir).groupBy("exam_id").agg(share("easy"), share("medium"), share("hard"))
    return s.withColumn("off", (F.abs(F.col("easy") - 30) > 15) | (F.abs(F.col("medium") - 45) > 15) | (F.abs(F.col("hard") - 25) > 15))


@query(f"""with {OPTIONS}, single as (select question_id, count(*) filter (is_correct) as right_ from options group by all),
p as (select l_orderkey as paper_id, count(*) as items, count(distinct l_discount) as penalties, max(coalesce(right_, 0)) as right_, max(case o_orderstatus when 'P' then 1 else 0 end) as failed, max(case o_orderstatus when 'O' then 1 else 0 end) as unvetted
    from lineitem join orders on l_orderkey = o_orderkey left join single on question_id = l_orderkey group by all),
c as (select paper_id, items, (failed + unvetted) * items + case when right_ = 0 then items else 0 end as critical, case when penalties > 1 then 1 else 0 end as major from p)
select paper_id, cast(items as bigint) as items, cast(critical as bigint) as critical, cast(major as bigint) as major,
    case when critical > 0 then 'failed' when major > 0 then 'review' else 'pass' end as verdict, critical = 0 and major = 0 as publishable, round(greatest(0.0, least(1.0, 1.0::double - critical * 0.2::double - major * 0.06::double)), 6) as score from c""")
def paper_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, score and release gate of every paper, with orders as papers of one question's options."""
    right = options(spark, sf_dir).groupBy("question_id").agg(F.count_if("is_correct").alias("right"))
    bad = questions(spark, sf_dir).select("question_id", (F.col("quality") != "pass").cast("int").alias("bad"))
    i = table(spark, sf_dir, "lineitem").join(bad, F.col("l_orderkey") == F.col("question_id"))
    p = i.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count("*").alias("items"), F.count_distinct("l_discount").alias("penalties"), F.max("bad").alias("bad"))
    p = p.join(right, F.col("paper_id") == F.col("question_id"), "left")
    critical = F.col("bad") * F.col("items") + F.when(F.coalesce("right", F.lit(0)) == 0, F.col("items")).otherwise(0)
    p = p.select("paper_id", "items", critical.cast("long").alias("critical"), (F.col("penalties") > 1).cast("long").alias("major"))
    verdict = F.when(F.col("critical") > 0, "failed").when(F.col("major") > 0, "review").otherwise("pass")
    return p.select("*", verdict.alias("verdict"), (verdict == "pass").alias("publishable"), F.round(W.score(F.col("critical"), F.col("major"), F.lit(0), F.col("items")), 6).alias("score"))


_PAPERS = """pa as (
    select o_orderkey as paper, 4 as questions, 1 as tolerance, o_totalprice as header_marks, o_orderkey % 3 * 0.05::double as header_negative, cast(o_orderkey % 4 * 30 as int) as minutes,
        case when o_orderpriority[1] = '1' then 60 else 0 end as expected_minutes, o_orderstatus <> 'P' as rated, o_orderstatus = 'O' as model_expected, o_orderkey % 5 = 0 as model_ran from orders
), it as (
    select l_orderkey as paper, l_linenumber as sequence, l_returnflag as section, p_type as subject, l_partkey as question_id, p_name as stem, case when l_discount > 0.08 then 'comprehension' end as type,
        case when p_size <= 15 then 'easy' when p_size <= 35 then 'medium' else 'hard' end as difficulty, case when l_tax > 0.06 then 'failed' when l_linestatus = 'F' then 'pass' else 'review' end as quality,
        l_linestatus = 'F' or l_returnflag = 'A' as has_answer, l_quantity as marks, l_discount as negative from lineitem join part on l_partkey = p_partkey
)"""


@query(f"""with {_PAPERS}, n as (select paper, count(*) as n, sum(marks) as marks, count(distinct negative) as penalties, count(*) filter (difficulty = 'easy') as easy, count(*) filter (difficulty = 'medium') as medium,
    count(*) filter (difficulty = 'hard') as hard from it group by paper), t as (select pa.*, coalesce(n, 0) as n, marks, penalties, easy, medium, hard from pa left join n using (paper)),
placed as (select *, row_number() over (partition by paper order by sequence, question_id) as place from it), key as (select *, regexp_replace(lower(stem), '[^a-z0-9]', '', 'g') as k from placed),
sec as (select t.paper, s.section, 2 as want, tolerance from t, (values ('R'), ('N')) s(section) where n > 0), cnt as (select paper, section, count(*) as got from it group by all),
every as (
    select paper, 'paper_empty' as code, 'critical' as severity, '' as field from t where n = 0
    union all select paper, 'paper_question_count_mismatch', case when n = 3 then 'major' else 'critical' end, '' from t where n > 0 and n <> 4
    union all select paper, 'paper_marks_mismatch', 'critical', '' from t where n > 0 and abs(header_marks - marks) > 0.01
    union all select paper, 'paper_negative_marks_wrong', 'major', '' from t where n > 0 and penalties > 1
    union all select paper, 'paper_negative_marks_wrong', 'critical', '' from t where n > 0 and header_negative <= 0
    union all select paper, 'paper_duration_missing', case when expected_minutes > 0 then 'critical' else 'major' end, '' from t where n > 0 and minutes <= 0
    union all select paper, 'paper_duration_missing', 'major', '' from t where n > 0 and minutes > 0 and expected_minutes > 0 and minutes <> expected_minutes
    union all select paper, 'paper_difficulty_unrated', 'major', '' from t where n > 0 and not rated
    union all select paper, 'paper_difficulty_distribution_off', 'major', '' from t where n > 0 and rated and (abs(easy * 100 // n - 30) > 15 or abs(medium * 100 // n - 45) > 15 or abs(hard * 100 // n - 25) > 15)
    union all select paper, 'model_review_not_run', 'major', '' from t where n > 0 and model_expected and not model_ran
    union all select paper, case when coalesce(got, 0) = 0 then 'paper_section_missing' else 'paper_section_count_mismatch' end, case when coalesce(got, 0) = 0 or want - got > tolerance or got > want then 'critical' else 'major' end, 'section:' || section
        from sec left join cnt using (paper, section) where coalesce(got, 0) <> want
    union all select paper, 'paper_subject_distribution_off', 'major', 'section:' || section from it group by paper, section having count(distinct subject) > 1
    union all select paper, 'paper_duplicate_question', 'critical', 'q' || sequence from placed qualify row_number() over (partition by paper, question_id order by place) > 1
    union all select paper, 'paper_repeated_stem', 'critical', 'q' || sequence from key where k <> '' qualify row_number() over (partition by paper, k order by place) > 1
    union all select paper, case quality when 'failed' then 'paper_failed_question' else 'paper_unvetted_question' end, 'critical', 'q' || sequence from it where quality <> 'pass'
    union all select paper, 'paper_missing_answer', 'critical', 'q' || sequence from it where not has_answer
    union all select paper, 'paper_broken_passage', 'critical', 'q' || sequence from it where type = 'comprehension'
    union all select paper, 'paper_sequence_gap', 'major', 'q' || min_by(sequence, place) from (select *, row_number() over (partition by paper order by sequence) as place from it) where sequence <> place group by paper
)
select paper, code, case when bool_or(severity = 'critical') then 'critical' else 'major' end as severity, field from every group by paper, code, field""")
def paper_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W00 with W01 to W17 and W20, W21: every paper validated as a whole, with orders as papers and their lines as items."""
    o = table(spark, sf_dir, "orders")
    papers = o.select(
        F.col("o_orderkey").alias("paper"), F.lit(4).alias("questions"), F.lit(1).alias("tolerance"), F.lit(None).cast("double").alias("expected_marks"), F.col("o_totalprice").alias("header_marks"), F.lit(0.05).alias("expected_negative"),
        (F.col("o_orderkey") % 3 * 0.05).alias("header_negative"), (F.col("o_orderkey") % 4 * 30).cast("int").alias("minutes"), F.when(F.col("o_orderpriority").startswith("1"), 60).otherwise(0).alias("expected_minutes"),
        F.struct(F.lit(30).alias("easy"), F.lit(45).alias("medium"), F.lit(25).alias("hard")).alias("want"), (F.col("o_orderstatus") != "P").alias("rated"), (F.col("o_orderstatus") == "O").alias("model_expected"), (F.col("o_orderkey") % 5 == 0).alias("model_ran"),
    )
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("string")
    items = met.select(
        F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("sequence"), F.col("l_returnflag").alias("section"), F.col("p_type").alias("subject"), F.col("l_partkey").alias("question_id"), F.col("p_name").alias("stem"),
        F.lit(None).cast("array<struct<text:string,is_correct:boolean>>").alias("options"), none.alias("answer"), none.alias("explanation"), F.lit(None).cast("long").alias("passage_id"), none.alias("passage"),
        F.when(F.col("l_discount") > 0.08, "comprehension").alias("type"), F.when(F.col("p_size") <= 15, "easy").when(F.col("p_size") <= 35, "medium").otherwise("hard").alias("difficulty"),
        F.when(F.col("l_tax") > 0.06, "failed").when(F.col("l_linestatus") == "F", "pass").otherwise("review").alias("quality"), ((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "A")).alias("has_answer"), F.col("l_quantity").alias("marks"), F.col("l_discount").alias("negative"),
    )
    sections = papers.select("paper", F.explode(F.array(F.lit("R"), F.lit("N"))).alias("section"), F.lit(2).alias("want"))
    return W.validated(papers, items, sections)
