"""A corpus pipeline of five stages over ``documents``: each stage's result is written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from examlake.llm.common import bucket_of, written
from examlake.llm.queries import TOXIC, VOCABULARY, digests, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the machine learns from the same fold as its query."""
    labels = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=[c for c in COLUMNS if c != "doc_id"])
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that too many pages of their source share; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``row``, which names each row: its place in its file, or a number that is written where docs come from no file."""
    try:
        return docs.select(*COLUMNS, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row"))
    except AnalysisException:
        return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest doc_id; of rows that repeat it, one.

    Rows without a doc_id come before all others.  Rows without words are in no component and stay.
    """
    docs = numbered(docs)
    found = minhash.near_duplicates(docs.select(F.struct("doc_id", "row").alias("id"), "text"), "id")
    gone = found.where(~F.col("kept")).select("id.row")
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item, whatever their doc_id."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=[c for c in COLUMNS if c != "doc_id"])
    return found.where("n_hit = 0").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    return digests(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

#: The first stage's machine and the last stage's tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over everything that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
