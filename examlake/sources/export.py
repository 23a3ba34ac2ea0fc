"""Paper sinks: an assembled paper as markdown, and the consecutive groups of a booklet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_groups(items: DataFrame, paper: str, order: str, by: str) -> DataFrame:
    """Add ``part``: consecutive items with the same ``by`` share one, and a value that returns later starts another."""
    w = Window.partitionBy(paper).orderBy(order)
    changed = F.coalesce((~F.col(by).eqNullSafe(F.lag(by).over(w))).cast("int"), F.lit(1))
    return items.withColumn("changed", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("part", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def number_text(value: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def markdown(items: DataFrame, paper: str, order: str, section: str, stem: str, options: str, with_key: bool = True) -> DataFrame:
    """``paper, text``: every paper as one markdown text, its sections headed where they begin, its key behind the questions.

    ``options`` is an array of structs with ``label``, ``text`` and
    ``is_correct``; a question without any keeps its place.  A paper's text is
    as long as the paper.
    """
    w = Window.partitionBy(paper).orderBy(order)
    starts = F.row_number().over(w) == 1
    opened = F.when(starts | ~F.col(section).eqNullSafe(F.lag(section).over(w)), F.concat(F.lit("\n## "), F.coalesce(F.col(section), F.lit("Section")), F.lit("\n\n"))).otherwise("")
    listed = F.coalesce(F.array_join(F.transform(options, lambda o: F.concat(F.lit("("), F.coalesce(o["label"], F.lit("")), F.lit(") "), F.coalesce(o["text"], F.lit("")))), "\n"), F.lit(""))
    question = F.concat(F.col(order).cast("string"), F.lit(". "), F.coalesce(F.col(stem), F.lit("")), F.lit("\n"), listed, F.lit("\n"))
    right = F.array_join(F.transform(F.filter(options, lambda o: o["is_correct"]), lambda o: o["label"]), ",")
    rows = items.select(paper, F.col(order).alias("at"), F.concat(opened, question).alias("q"), F.concat_ws(". ", F.col(order).cast("string"), F.nullif(right, F.lit(""))).alias("k"))
    packed = rows.groupBy(paper).agg(F.sort_array(F.collect_list(F.struct("at", "q", "k"))).alias("rows"))
    body = F.array_join(F.col("rows")["q"], "\n")
    key = F.concat(F.lit("\n## Answer key\n\n"), F.array_join(F.col("rows")["k"], "\n"), F.lit("\n"))
    return packed.select(paper, (F.concat(body, key) if with_key else body).alias("text"))
