"""Re-ingest of documents into a bank, findings about duplicates and spliced pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.operators import ingest as I
from examlake.plans.model import table
from examlake.registry import query

# Orders are questions and customers documents: every fifth order is in the bank already, customers with even keys come anew.
_INGEST = """q as (select o_orderkey, o_custkey as document_id, md5(strftime(o_orderdate, '%Y-%m-%d') || o_orderpriority) as content_hash, case when o_orderkey % 3 = 0 then cast(o_orderkey % 4 as int) end as answer from orders),
bank as (select 'b' || o_orderkey as question_id, case when o_orderkey % 10 > 0 then document_id end as document_id, content_hash, answer from q where o_orderkey % 5 = 0),
papers as (select 'b' || o_orderkey as question_id from q where o_orderkey % 15 = 0),
parsed as (select document_id, cast(row_number() over (partition by document_id order by o_orderkey) as int) as seq, content_hash, answer from q where document_id % 2 = 0),
batch as (select distinct document_id from parsed),
rest as (select question_id, case when document_id in (from batch) then null else document_id end as document_id, content_hash, answer from bank where document_id is null or document_id not in (from batch) or question_id in (from papers)),
known as (select content_hash, min(question_id) as known_id from rest group by all),
placed as (select p.*, known_id, 'n' || document_id || ':' || seq as own_id from parsed p left join known using (content_hash)),
firsts as (select content_hash, min(document_id) as first_document, arg_min(own_id, document_id * 100000 + seq) as first_id from placed where known_id is null group by all),
links as (select p.document_id, seq, coalesce(known_id, case when p.document_id = first_document then own_id else first_id end) as question_id, known_id is not null or p.document_id <> first_document as reused, p.answer from placed p left join firsts using (content_hash)),
gains as (select question_id, arg_min(answer, document_id * 100000 + seq) as gained from links where reused and answer is not null group by all),
made as (select own_id as question_id, document_id, content_hash, answer from placed join firsts using (content_hash) where known_id is null and document_id = first_document)"""


def bank_and_parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("document_id"), F.md5(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").cast("binary")).alias("content_hash"), F.when(key % 3 == 0, (key % 4).cast("int")).alias("answer")
    )
    name = F.concat(F.lit("b"), key.cast("string")).alias("question_id")
    bank = q.where("o_orderkey % 5 = 0").select(name, F.when(key % 10 > 0, F.col("document_id")).alias("document_id"), "content_hash", "answer")
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("o_orderkey"))
    return bank, q.where("document_id % 2 = 0").select("document_id", seq.alias("seq"), "content_hash", "answer"), q.where("o_orderkey % 15 = 0").select(name)


@query(f"with {_INGEST} select question_id, document_id, content_hash, coalesce(answer, gained) as answer from (select * from rest union all select * from made) left join gains using (question_id)")
def ingested_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank after half of the documents came again."""
    return I.ingested(*bank_and_parsed(spark, sf_dir))[0]


@query(f"with {_INGEST} select document_id, seq, question_id, reused from links")
def ingested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which question of the bank each parsed question is."""
    return I.ingested(*bank_and_parsed(spark, sf_dir))[1]


@query("""with m as (select o_orderkey as question_id, o_orderkey - o_orderkey % 4 as other, o_orderkey % 4 = 1 as exact, case when o_orderkey % 4 = 1 then 1.0 else 0.80 + (o_orderkey % 19) / 100.0 end :: double as similarity, repeat('stem ' || o_orderkey || ' ', cast(o_orderkey % 30 as int)) as stem from orders where o_orderkey % 4 > 0)
select question_id, case when exact then 'duplicate_question' else 'near_duplicate_question' end as code, case when exact then 'critical' else 'major' end as severity,
    'question ' || other || case when exact then ' is the same question' else ' says nearly the same thing (' || cast(round(similarity * 100) as int) || '% similar)' end as message,
    case when length(trim(stem)) > 110 then left(trim(stem), 109) || '…' else trim(stem) end as evidence from m""")
def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of questions as findings."""
    key = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(
        key.alias("question_id"), (key - key % 4).alias("other"), (key % 4 == 1).alias("exact"), F.when(key % 4 == 1, 1.0).otherwise(0.80 + (key % 19) / 100.0).alias("similarity"),
        F.repeat(F.concat(F.lit("stem "), key.cast("string"), F.lit(" ")), (key % 30).cast("int")).alias("stem"),
    )
    return I.duplicate_issues(m, "question_id").select("question_id", F.inline("issues"))


@query("""with p as (select l_suppkey as document, l_linenumber as page, l_linenumber - 1 as ordinal, trim(string_agg('line ' || l_orderkey, chr(10) order by l_orderkey)) as text from lineitem where l_linenumber <> l_suppkey % 7 + 1 group by all),
r as (select distinct l_suppkey as document, l_linenumber as page, 'read ' || l_suppkey || ' ' || l_linenumber as text from lineitem where (l_suppkey + l_linenumber) % 3 = 0 or l_linenumber = l_suppkey % 7 + 1),
m as (select coalesce(p.document, r.document) as document, coalesce(p.page, r.page) as page, ordinal, case when r.text is null then p.text when p.text is null then r.text else r.text || chr(10) || chr(10) || p.text end as text from p full join r on p.document = r.document and p.page = r.page),
o as (select *, row_number() over (partition by document order by ordinal nulls last, page) as k from m)
select document, md5(string_agg('[page] ' || page || chr(10) || chr(10) || text, chr(10) || chr(10) order by k)) as text_md5, count(*) as pages from o group by document""")
def spliced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some pages were read again and one page only then."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("page"), "l_orderkey")  # noqa: E741
    line = F.concat(F.lit("line "), F.col("l_orderkey").cast("string"))
    pages = l.where("page <> document % 7 + 1").groupBy("document", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_orderkey", line.alias("t"))))["t"], "\n").alias("text")).withColumn("ordinal", F.col("page") - 1)
    read = l.where("(document + page) % 3 = 0 or page = document % 7 + 1").select("document", "page").distinct().withColumn("text", F.concat(F.lit("read "), F.col("document").cast("string"), F.lit(" "), F.col("page").cast("string")))
    made = I.spliced(pages, read, "document")
    counts = made.groupBy("document").agg(F.count("*").alias("pages"))
    return I.joined(made, "document").join(counts, "document").select("document", F.md5(F.col("text").cast("binary")).alias("text_md5"), "pages")
