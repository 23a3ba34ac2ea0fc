"""Parsed questions into a bank: a delta of tables that gives the same bank however often a document comes (M01, D05), findings about duplicates (D04), pages spliced into a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions.text import shortened
from examlake.plans.tables import kept


def ingested(bank: DataFrame, parsed: DataFrame, in_papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bank`` (question_id, document_id, content_hash, answer, ...) with the documents of ``parsed`` replaced, and ``document_id, seq, question_id, reused``.

    ``parsed`` has ``document_id, seq, content_hash, answer`` and the bank's other
    columns; ``in_papers`` (question_id) names questions that papers hold.  What
    the documents brought before goes, except that questions in papers stay and
    belong to no document.  A parsed question whose hash the bank holds is that
    one, the smallest of several; otherwise the first document that has the hash
    brings it, and later ones reuse its first.  A question without an answer
    takes the first that comes with a reuse.  Identifiers are made of document and
    place, so ingesting twice changes nothing.  A null hash is equal to none.
    """
    others = [c for c in bank.columns if c not in ("question_id", "document_id", "content_hash", "answer")]
    batch = parsed.select("document_id").distinct().withColumn("comes", F.lit(True))
    held = in_papers.select("question_id").distinct().withColumn("held", F.lit(True))
    met = bank.join(batch, "document_id", "left").join(held, "question_id", "left")
    rest = met.where("comes is null or held").withColumn("document_id", F.when(F.col("comes").isNull(), F.col("document_id"))).select(*bank.columns)
    rest = kept(rest, "rest")
    known = rest.where("content_hash is not null").groupBy("content_hash").agg(F.min("question_id").alias("known_id"))
    own = F.concat(F.lit("n"), F.col("document_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    placed = parsed.withColumn("own_id", own).join(known, "content_hash", "left")
    first = placed.where("known_id is null and content_hash is not null").groupBy("content_hash").agg(F.min(F.struct("document_id", "seq", "own_id")).alias("first"))
    placed = kept(placed.join(first.select("content_hash", F.col("first.document_id").alias("first_document"), F.col("first.own_id").alias("first_id")), "content_hash", "left"), "placed")
    new = F.col("known_id").isNull() & (F.col("content_hash").isNull() | (F.col("document_id") == F.col("first_document")))
    links = placed.select("document_id", "seq", F.when(new, F.col("own_id")).otherwise(F.coalesce("known_id", "first_id")).alias("question_id"), (~new).alias("reused"), "answer")
    gains = links.where("reused and answer is not null").groupBy("question_id").agg(F.min(F.struct("document_id", "seq", "answer"))["answer"].alias("gained"))
    made = placed.where(new).select(F.col("own_id").alias("question_id"), "document_id", "content_hash", "answer", *others)
    out = rest.select(*made.columns).union(made).join(gains, "question_id", "left").withColumn("answer", F.coalesce("answer", "gained"))
    return out.select(*bank.columns), links.drop("answer")


def duplicate_issues(matches: DataFrame, key: str) -> DataFrame:
    """``key, issues`` of rows with matches (key, other, exact, similarity, stem): a copy is critical, a near match major; copies come first, then the most similar."""
    other, share = F.col("other").cast("string"), F.format_string("%.0f%% similar)", F.bround(F.col("similarity") * 100))
    said = F.when(F.col("exact"), F.concat(F.lit("question "), other, F.lit(" is the same question"))).otherwise(F.concat(F.lit("question "), other, F.lit(" says nearly the same thing ("), share))
    issue = F.struct(F.when(F.col("exact"), "duplicate_question").otherwise("near_duplicate_question").alias("code"), F.when(F.col("exact"), "critical").otherwise("major").alias("severity"), said.alias("message"), shortened(F.col("stem"), 110).alias("evidence"))
    order = F.struct((~F.col("exact")).cast("int").alias("turn"), (-F.col("similarity")).alias("unlike"), "other", issue.alias("issue"))
    return matches.groupBy(key).agg(F.sort_array(F.collect_list(order))["issue"].alias("issues"))


def spliced(pages: DataFrame, read: DataFrame, document: str) -> DataFrame:
    """``pages`` (document, page, ordinal, text), the marked pages of each document's text, with what was ``read`` (document, page, text) of some of them again.

    A page's new text comes right behind its first mark, before what stands there;
    pages without a mark come behind all others in the order of their numbers.
    Documents of either side are in the result; blank readings change nothing.
    """
    fresh = read.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(document, "page").agg(F.max("text").alias("fresh"))
    met = pages.join(fresh, [document, "page"], "full")
    first = F.row_number().over(Window.partitionBy(document, "page").orderBy(F.col("ordinal").asc_nulls_last())) == 1
    text = F.concat_ws("\n\n", F.when(first, F.trim("fresh")), F.nullif(F.trim("text"), F.lit("")))
    met = met.withColumn("made", text)
    order = Window.partitionBy(document).orderBy(F.col("ordinal").asc_nulls_last(), "page")
    return met.select(document, "page", (F.row_number().over(order) - 1).alias("ordinal"), F.col("made").alias("text"), F.col("fresh").isNotNull().alias("read"))


def joined(pages: DataFrame, document: str) -> DataFrame:
    """``document, text``: pages in order, each behind its mark."""
    mark: Column = F.concat(F.lit("[page] "), F.col("page").cast("string"), F.lit("\n\n"), "text")
    return pages.groupBy(document).agg(F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", mark.alias("t"))))["t"], "\n\n").alias("text"))
