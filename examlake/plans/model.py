"""The question-bank model over the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exam_id, exam_name``."""
    return table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("exam_id"), F.col("r_name").alias("exam_name"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, subject_name, exam_id``."""
    n = table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") + 1).alias("subject_id"), F.col("n_name").alias("subject_name"), (F.col("n_regionkey") + 1).alias("exam_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question: owner, year, difficulty, verdict, extraction confidence and estimated seconds."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    q = o.join(c, o.o_custkey == c.c_custkey).join(subjects(spark, sf_dir), F.col("c_nationkey") + 1 == F.col("subject_id"))
    level = F.substring("o_orderpriority", 1, 1)
    return q.select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_custkey").alias("document_id"),
        "subject_id",
        "subject_name",
        "exam_id",
        F.year("o_orderdate").alias("year"),
        F.when(level <= "2", "hard").when(level == "3", "medium").otherwise("easy").alias("difficulty"),
        F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "review").otherwise("failed").alias("quality"),
        F.col("o_orderpriority").alias("topic"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("confidence"),
        (F.lit(30) + F.col("o_orderkey") % 91).cast("int").alias("seconds"),
    )


QUESTIONS = """
questions as (
    select o_orderkey as question_id, o_custkey as document_id, n_nationkey + 1 as subject_id, n_name as subject_name,
        n_regionkey + 1 as exam_id, cast(year(o_orderdate) as int) as year,
        case when o_orderpriority[1] <= '2' then 'hard' when o_orderpriority[1] = '3' then 'medium' else 'easy' end as difficulty,
        case o_orderstatus when 'F' then 'pass' when 'O' then 'review' else 'failed' end as quality, o_orderpriority as topic,
        (o_orderkey % 100) / 100.0 as confidence, cast(30 + o_orderkey % 91 as int) as seconds
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)"""

#: What orders the options of a question; the last columns only break ties.
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, position, text, is_correct``: a question's choices from position 1."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    return rows.select(F.col("l_orderkey").alias("question_id"), position.alias("position"), F.col("p_name").alias("text"), (F.col("l_returnflag") == "R").alias("is_correct"))


OPTIONS = f"""
options as (
    select l_orderkey as question_id, cast(row_number() over (partition by l_orderkey order by {", ".join(_ORDER)}) as int) as position,
        p_name as text, l_returnflag = 'R' as is_correct
    from lineitem join part on l_partkey = p_partkey
)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their options as one array, empty where a question has none."""
    packed = options(spark, sf_dir).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("position", "text", "is_correct"))).alias("options"))
    empty = F.array().cast("array<struct<position:int,text:string,is_correct:boolean>>")
    return questions(spark, sf_dir).join(packed, "question_id", "left").withColumn("options", F.coalesce("options", empty))


#: (association, borrowing exam, source exam, subject or None for all, similarity, enabled)
ASSOCIATIONS = [(1, 1, 2, None, 0.9, True), (2, 2, 3, None, 0.7, True), (3, 3, 4, 4, 0.8, True), (4, 4, 5, None, 0.0, True), (5, 5, 1, None, 0.6, False), (6, 1, 3, 3, 0.95, True)]
ASSOCIATIONS_SQL = "associations(association_id, exam_id, source_exam_id, scope_id, similarity, enabled) as (values " + ", ".join(f"({a}, {b}, {c}, {'null' if d is None else d}, {e}, {str(f).lower()})" for a, b, c, d, e, f in ASSOCIATIONS) + ")"


def associations(spark: SparkSession) -> DataFrame:
    """Exams that borrow another exam's questions: a rule table of a few rows."""
    return spark.createDataFrame(ASSOCIATIONS, "association_id int, exam_id int, source_exam_id int, scope_id int, similarity double, enabled boolean")
