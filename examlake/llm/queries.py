"""The operators of this package bound to the driver's tables: ``queries()`` and ``oracle_sql()`` of the entry module take them from here."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import bpe, decontaminate, lattice_lm, line_dedup, minhash, partenum, prefix_trie, quality_fm, quality_rules, token_counts, toxicity, warc, whitening
from examlake.llm.common import bucket_of, new_path, written
from examlake.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

#: Of the tokenizer that queries 2 and 3 use, and of the pieces behind query 9.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens beyond which query 3 says over_limit, and scores from which queries 4 and 10 predict 1.
TOKEN_LIMIT, GOOD, TOXIC = 1024, 0.3, 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; the cache starts empty, so each distinct text is encoded in this run."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, new_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a machine that never saw the fold held out."""
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    machine = quality_fm.fit(docs, labels.where(bucket_of("doc_id", 5) != 0))
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    found = quality_rules.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back: one row per capture."""
    path = new_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    # Archives are read and their payloads checked once; what the joins need of them is written.
    found = warc.captures(written(warc.read(spark, path).drop("payload"), "records"), with_payload=False)
    page = F.regexp_extract("metadata.fields", r"capture: (-?\d+)", 1).cast("long")
    rows = found.select(page.alias("page_id"), "id", F.coalesce("refers_to", "id").alias("first"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"))
    firsts = rows.select(F.col("id").alias("first"), F.col("page_id").alias("first_page"))
    return rows.join(firsts, "first").select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("first_page")).alias("refers_to"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source, as a digest of the text that is left."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; the fold held out teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (bucket_of("doc_id", 7) != 2).alias("training"))
    scored = lattice_lm.score(docs, "training", PIECES)
    return scored.select("doc_id", (bucket_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a machine that never saw the fold held out."""
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(bucket_of("doc_id", 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components of the distinct ones, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those whose 4-word shingles agree to 85 percent."""
    return partenum.similar_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_bpe, op3_token_counts, op4_quality, op5_quality_rules, op6_warc, op7_line_dedup, op8_decontaminate, op9_lattice_lm, op10_toxicity, op11_prefix_trie, op12_whitening, op13_partenum, pipeline)
}
