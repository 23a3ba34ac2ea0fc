"""Reachability of questions from exams, recomputed rather than maintained: a direct link wins, then the oldest association."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relevance of a borrowed question whose association has no similarity.
DEFAULT_RELEVANCE = 0.5


def direct_links(questions: DataFrame) -> DataFrame:
    """``question_id, exam_id, link_type, relevance, association_id`` of every question and its own exam."""
    return questions.where("exam_id is not null").select("question_id", "exam_id", F.lit("direct").alias("link_type"), F.lit(1.0).alias("relevance"), F.lit(None).cast("int").alias("association_id"))


def associated_links(questions: DataFrame, associations: DataFrame) -> DataFrame:
    """Links through enabled associations, limited to a subject where one is named; several ways to one exam stay several rows."""
    a = associations.where("enabled").select("association_id", F.col("exam_id").alias("to_exam"), "source_exam_id", "scope_id", "similarity")
    met = questions.join(a, (F.col("exam_id") == F.col("source_exam_id")) & (F.col("scope_id").isNull() | (F.col("scope_id") == F.col("subject_id"))))
    relevance = F.when(F.col("similarity") > 0, F.least("similarity", F.lit(1.0))).otherwise(F.lit(DEFAULT_RELEVANCE))
    return met.select("question_id", F.col("to_exam").alias("exam_id"), F.lit("associated").alias("link_type"), relevance.alias("relevance"), "association_id")


def all_links(questions: DataFrame, associations: DataFrame) -> DataFrame:
    """One link for each question and exam: one aggregation with map-side minima, no window."""
    every = direct_links(questions).unionByName(associated_links(questions, associations))
    first = F.min(F.struct(F.coalesce("association_id", F.lit(0)).alias("rank"), "link_type", "relevance", "association_id"))
    return every.groupBy("question_id", "exam_id").agg(first.alias("x")).select("question_id", "exam_id", "x.link_type", "x.relevance", "x.association_id")
