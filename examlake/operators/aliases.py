"""Subject recognition by aliases that are data: exact heading, contained alias or overlapping words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.functions.text import heading

#: A match below this score is none; a contained alias has at least so many bytes.
LEAST_SCORE, LEAST_BYTES, COVERAGE, DENSITY = 0.75, 4, 0.75, 0.6


def index(aliases: DataFrame, entry: str, alias: str, ordinal: str) -> DataFrame:
    """``alias, entry, ordinal, words``: normalised aliases, the first entry owning an alias that several claim."""
    rows = aliases.select(heading(F.col(alias)).alias("alias"), F.col(entry).alias("entry"), F.col(ordinal).alias("ordinal")).where("alias <> ''")
    first = rows.groupBy("alias").agg(F.min(F.struct("ordinal", "entry")).alias("x")).select("alias", "x.entry", "x.ordinal")
    return first.withColumn("words", F.split("alias", " "))


def matched(lines: DataFrame, key: list[str], line: str, index_: DataFrame) -> DataFrame:
    """``key…, entry, alias, score`` of lines that name an entry; the best score wins, then the earlier entry.

    Every way to match shares a word with the line or, for an alias inside a
    longer word, begins with a pair of its letters, so candidates meet by an
    equi join on words and on those pairs instead of a product of lines and aliases.
    """
    rows = lines.select(*key, heading(F.col(line)).alias("norm")).where("norm <> ''")
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2))))
    seeds = F.array_distinct(F.concat(F.split("norm", " "), pieces(F.col("norm"))))
    a = index_.select("*", F.explode(F.array_distinct(F.concat("words", F.array(F.col("alias").substr(F.lit(1), F.lit(2)))))).alias("seed"))
    met = rows.distinct().select(*key, "norm", F.explode(seeds).alias("seed")).join(a, "seed").drop("seed").dropDuplicates([*key, "norm", "alias"])
    words = F.split("norm", " ")
    shared = F.size(F.filter("words", lambda w: F.array_contains(words, w)))
    coverage, density = shared / F.size("words"), shared / F.size(words)
    inside = (F.octet_length("alias") >= LEAST_BYTES) & F.contains("norm", F.col("alias"))
    score = (
        F.when(F.col("norm") == F.col("alias"), 1.0)
        .when(inside, F.least(F.lit(0.95), 0.70 + 0.25 * F.octet_length("alias") / F.octet_length("norm")))
        .when((coverage >= COVERAGE) & (density >= DENSITY), 0.5 * coverage + 0.45 * density)
    )
    best = F.max(F.struct("score", (-F.col("ordinal")).alias("early"), "entry", "alias"))
    found = met.withColumn("score", score).where(F.col("score") >= LEAST_SCORE)
    return found.groupBy(*key).agg(best.alias("x")).select(*key, "x.entry", "x.alias", "x.score")
