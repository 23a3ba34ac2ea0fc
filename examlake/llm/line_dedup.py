"""Site-relative line deduplication: lines on too large a share of a host's pages are boilerplate and go.

Pages are a host's distinct texts, so copies of a page count once.  Lines travel
as 64-bit hashes; the texts move once, to meet the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
#: A line goes if it is on more than this share of the host's pages and on at least so many of them.
RATIO, LEAST_PAGES = 0.02, 5


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped``: lines with a word before, and those that went.

    Rows without a host are one host.  Blank lines stay.  Null texts stay null
    with no lines; a text of nothing but boilerplate becomes empty.  All
    other columns and all rows stay, but for columns named as the two new ones;
    repeated rows are treated alike.
    """
    docs = docs.drop("n_lines", "n_dropped")
    kept_names = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept_names).alias("own"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, _SPACES, "") != "")
    pages = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    on = rows.select("host", "page", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"))
    often = on.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    boilerplate = often.join(pages, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")
    losses = on.join(boilerplate, ["host", "line"], "left_semi").groupBy("host", "page").agg(F.collect_set("line").alias("lost"))
    met = rows.join(losses, ["host", "page"], "left")
    goes = lambda x: F.coalesce(F.array_contains("lost", F.xxhash64(x)), F.lit(False)) & (F.translate(x, _SPACES, "") != "")
    left = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~goes(x)), "\n"))
    out = met.select("own", left.alias("new"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size(F.filter(lines, goes))).cast("long").alias("n_dropped"))
    return out.select(*(F.col("new").alias(c) if c == text else F.col(f"own.{c}") for c in docs.columns), "n_lines", "n_dropped")
