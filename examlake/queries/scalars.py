"""Text functions over documents, and answers of key documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import answer_keys
from examlake.plans.model import table
from examlake.registry import query


@query(r"""with d as (select doc_id, coalesce(text, '') as t, cast(doc_id % 997 as int) - 1 as pos from documents),
e as (select *, case when pos < 0 then '' else trim(regexp_replace(substr(t, greatest(pos - 30, 0) + 1, greatest(least(pos + 30, length(t)) - greatest(pos - 30, 0), 0)), '[ \t\n\f\r]+', ' ', 'g'), ' ') end as x,
    trim(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F\x{FFFD}\x{FFFE}\x{FFFF}]', '', 'g'), chr(9) || chr(10) || ' ') as p from d)
select doc_id, case when length(x) > 70 then left(x, 69) || '…' else x end as excerpt, md5(p) as printable_md5 from e""")
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each document around a place, and its text as it prints."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(t, (F.col("doc_id") % 997).cast("int") - 1).alias("excerpt"), F.md5(T.printable(t).cast("binary")).alias("printable_md5"))


@query(r"""with d as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g'), ' ') as t from documents), h as (select *, left(t, 59) as head from d),
c as (select *, length(head) - length(regexp_extract(head, '[^ ]*$')) - 1 as sp from h)
select doc_id, case when length(t) <= 60 then t else trim(case when sp > length(head) - 20 and sp > 0 then left(head, sp) else head end, ' ') || '…' end as cut, strlen(t) > 80 as truncated from c""")
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at a word, and whether they exceed a number of bytes."""
    t = T.collapse(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_at_word(t, 60).alias("cut"), T.limited_bytes(t, 80)["truncated"].alias("truncated"))


@query("""with n as (select o_custkey, list(case when o_orderkey % 2 = 0 then upper(o_orderpriority) else ' ' || lower(o_orderpriority) || ' ' end order by o_orderkey) as names from orders group by all)
select o_custkey as subject, to_json(list_transform(list_filter(range(1, len(names) + 1), lambda i: not list_contains(list_transform(names[1:i - 1], lambda y: lower(trim(y))), lower(trim(names[i])))), lambda i: trim(names[i]))) :: varchar as stored from n""")
def stored_alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a subject as they are stored, read back and stored again."""
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", name.alias("name"))))["name"].alias("names"))
    return n.select("subject", T.stored_aliases(T.aliases_of(T.stored_aliases(F.col("names")))).alias("stored"))


@query("""with q as (select o_orderkey as question_id, cast(o_custkey % 4 as int) as exam_id, cast(2000 + o_custkey % 3 as int) as year, o_custkey as document_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as number,
    case when o_orderkey % 3 = 0 then 1 end as answer, case when o_orderkey % 2 = 0 then 'own' else '' end as explanation, cast(o_orderkey % 3 + 2 as int) as n_options from orders),
k as (select s_suppkey as key_id, case when s_suppkey % 5 > 0 then cast(s_suppkey % 4 as int) end as exam_id, case when s_suppkey % 2 = 0 then cast(2000 + s_suppkey % 3 as int) end as year from supplier),
a as (select key_id, exam_id, year, number, cast((key_id + number) % 5 as int) as option, case when number % 3 = 0 then 'solved ' || key_id else '' end as explanation from k, (select unnest(range(1, 9)) :: int as number) where (key_id + number) % 4 > 0),
latest as (select c_custkey as document_id from customer where c_mktsegment = 'BUILDING' and c_custkey % 2 = 0 order by c_acctbal desc, c_custkey desc limit 1),
m as (select q.question_id, a.key_id, a.option, a.explanation as said, q.n_options, q.answer, q.explanation from q join a on q.number = a.number and case when a.exam_id is null then q.document_id = (from latest) else q.exam_id = a.exam_id and (a.year is null or a.year = q.year) end),
o as (select question_id, arg_min(option, key_id) as option from m where answer is null and option < n_options group by all), e as (select question_id, arg_min(said, key_id) as said from m where explanation = '' and said <> '' group by all)
select question_id, coalesce(answer, option) as answer, coalesce(said, explanation) as explanation, option is not null or said is not null as changed from q left join o using (question_id) left join e using (question_id)""")
def key_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions that separate keys answer, by exam and year or for the latest paper."""
    key = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(
        key.alias("question_id"), (F.col("o_custkey") % 4).cast("int").alias("exam_id"), (F.col("o_custkey") % 3 + 2000).cast("int").alias("year"), F.col("o_custkey").alias("document_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("number"), F.when(key % 3 == 0, 1).alias("answer"), F.when(key % 2 == 0, "own").otherwise("").alias("explanation"),
        F.array_repeat(F.lit("x"), (key % 3 + 2).cast("int")).alias("options"),
    )
    s = F.col("s_suppkey")
    keys = table(spark, sf_dir, "supplier").select(s.alias("key_id"), F.when(s % 5 > 0, (s % 4).cast("int")).alias("exam_id"), F.when(s % 2 == 0, (s % 3 + 2000).cast("int")).alias("year"))
    each = keys.select("key_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("number")).where("(key_id + number) % 4 > 0")
    answers = each.select("key_id", "number", ((F.col("key_id") + F.col("number")) % 5).cast("int").alias("option"), F.when(F.col("number") % 3 == 0, F.concat(F.lit("solved "), F.col("key_id").cast("string"))).otherwise("").alias("explanation"))
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 2 == 0, "question_paper").otherwise("other").alias("kind"), F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("failed").alias("status"), F.col("c_acctbal").alias("created"))
    return answer_keys.key_answers_applied(q, keys, answers, papers).select("question_id", "answer", "explanation", "changed")
