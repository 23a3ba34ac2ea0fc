"""Distinct-word tables: count the pieces of all texts, value each distinct piece once, bring the values back to the texts.

Pieces follow Zipf's law, so the values come back by two joins.  Frequent
pieces, at most ``head`` of them whatever the corpus, are looked up in a
broadcast table; occurrences of all others are rows that Spark joins by piece.
No piece of the second kind is frequent, so that join has no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import small_batches, texts_of

#: Distinct pieces that a task holds before it passes its counts on.
HELD = 200_000
#: Most rows of a broadcast head: about 35 MB as a Python dictionary.
HEAD = 200_000


def count_pieces(docs: DataFrame, split: Callable[[bytes], list[bytes]], chosen: str | None = None) -> DataFrame:
    """``piece binary, n long, t long``: how often each distinct piece stands in the texts of ``docs`` (column ``text``).

    ``t`` counts only rows whose boolean column ``chosen`` is true (all rows
    without one).  Tasks sum what they hold before anything is shuffled.  Null
    and empty texts have no pieces; an empty frame gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def out(side: int) -> pa.RecordBatch:
            words = held[side]
            n = pa.array(words.values(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), n, n if side else pa.array([0] * len(words), pa.int64())], ["piece", "n", "t"])
            words.clear()
            return batch

        for batch in batches:
            sides = batch.column("chosen").to_pylist()
            for text, side in zip(texts_of(batch), sides, strict=True):
                held[side].update(split(text))
                if len(held[side]) > HELD:
                    yield out(side)
        for side in (0, 1):
            if held[side]:
                yield out(side)

    small_batches(docs.sparkSession)
    rows = docs.select("text", (F.coalesce(F.col(chosen), F.lit(False)) if chosen else F.lit(True)).alias("chosen"))
    return rows.mapInArrow(run, "piece binary, n long, t long").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def head_of(table: DataFrame, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Split a piece table at the least count that leaves at most ``head`` rows above it: (frequent, others).

    The count is found from one row for each small count and each power of two
    beyond, so nothing that grows with the table reaches the driver.
    """
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    least, rows = 1 << 62, 0
    for n, many in sorted(((r["step"], r["many"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("many")).collect()), reverse=True):
        if rows + many > head:
            break
        least, rows = n, rows + many
    return table.where(F.col("n") >= least), table.where(F.col("n") < least)
