"""Exact duplicates by key and near duplicates by an exact set join, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions.text import trigrams
from examlake.plans.tables import kept, once, small_batches

PERCENT, LEAST_BYTES, MOST_MATCHES = 82, 40, 5
#: Sets of a block, trigrams that a product takes at once, and rows of a product whose pairs are passed on at once.
BLOCK, GRAMS, STRIPE = 2048, 4096, 64


def grouped_by_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """``by, copies, first`` of keys held more than once; copies are counted, never paired."""
    return rows.groupBy(by).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def similar_pairs(rows: DataFrame, key: str, subject: str, stem: str, percent: int = PERCENT, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``a, b, shared, total`` for distinct stems of one subject whose trigram sets have 100 * shared >= percent * total.

    Equal stems are one entry under their smallest key, so copies are not
    paired.  Similar sets lie in one band of sizes or in two neighbouring ones.  A
    band's sets fall into blocks of about BLOCK, and each pair of blocks is
    compared whole by matrix products: only similar pairs leave a task, so what is
    shuffled and held does not grow with the candidates.  Nothing is approximate.
    """
    stems = rows.where(F.col(subject).isNotNull() & (F.octet_length(stem) >= least_bytes)).groupBy(F.col(subject).alias("subject"), F.col(stem).alias("stem")).agg(F.min(key).alias("key"))
    sets = once(stems.select("subject", "key", "stem"), set=trigrams(F.col("stem"))).select("subject", "key", F.size("set").alias("n"), F.array_join("set", "\n").alias("grams")).where("n > 0")
    # A little wider than the ratio of similar sizes, so that no rounding parts them by two bands.
    width = max(log(100 / percent), 1e-3) * (1 + 1e-9)
    sets = kept(sets.withColumn("band", F.floor(F.log("n") / width).cast("int")), "sets")
    blocks = sets.groupBy("subject", "band").agg(F.expr(f"cast((count(*) + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    around = blocks.join(blocks.select("subject", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")), ["subject", "band"], "left")
    around = around.join(blocks.select("subject", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), ["subject", "band"], "left")
    own = F.pmod(F.xxhash64("key", "grams"), F.col("blocks")).cast("int")
    met = sets.join(around, ["subject", "band"]).withColumn("own", own)
    others = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    cell = lambda band, i, j, next_, side: F.struct(band.cast("int").alias("at"), i.alias("i"), j.alias("j"), F.lit(next_).alias("next"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<at:int,i:int,j:int,next:boolean,side:int>>")
    cells = F.concat(
        others("blocks", lambda j: cell(F.col("band"), F.least("own", j), F.greatest("own", j), False, F.when(F.col("own") <= j, 0).otherwise(1))),
        F.when(F.col("above").isNotNull(), others("above", lambda j: cell(F.col("band"), F.col("own"), j, True, F.lit(0)))).otherwise(none),
        F.when(F.col("below").isNotNull(), others("below", lambda j: cell(F.col("band") - 1, j, F.col("own"), True, F.lit(1)))).otherwise(none),
    )
    by = ["subject", "at", "i", "j", "next"]
    spread = met.select("subject", "key", "n", "grams", F.explode(cells).alias("c")).select("subject", "key", "n", "grams", "c.*").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    kind = sets.schema["key"].dataType.simpleString()
    small_batches(rows.sparkSession)
    found = spread.mapInArrow(_similar(percent), f"x {kind}, y {kind}, shared long, total long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "total")


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Similar pairs of sorted groups of sets: those across the two sides of a group, or within its only side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            sides = [[h for h in held if h[2] == side] for side in (0, 1)]
            alone = not at[4] and at[2] == at[3]
            left, right = sides[0], sides[0] if alone else sides[1]
            if left and right:
                shared, sizes = _shared(left, right)
                total = sizes[0][:, None] + sizes[1][None, :] - shared
                near = 100 * shared >= percent * total
                if alone:
                    near = np.triu(near, 1)
                for begin in range(0, len(left), STRIPE):
                    x, y = np.nonzero(near[begin : begin + STRIPE])
                    x += begin
                    columns = [pa.array([rows[i][0] for i in z.tolist()], kind) for rows, z in ((left, x), (right, y))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(shared[x, y].astype(np.int64)), pa.array(total[x, y].astype(np.int64))], ["x", "y", "shared", "total"])
            held.clear()

        for batch in batches:
            kind = batch.column("key").type
            for *now, key, grams, side in zip(*(batch.column(c).to_pylist() for c in ("subject", "at", "i", "j", "next", "key", "grams", "side")), strict=True):
                if now != at:
                    if held:
                        yield from found()
                    at = now
                held.append((key, grams, side))
        if held:
            yield from found()

    return run


def _shared(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """How many trigrams each set of one side shares with each of the other, and the sets' sizes; GRAMS columns are multiplied at a time."""
    ids: dict[str, int] = {}
    sides = []
    for rows in (left, right):
        sets = [[ids.setdefault(g, len(ids)) for g in r[1].split("\n")] for r in rows]
        sizes = np.array([len(s) for s in sets])
        sides.append((np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.array(s) for s in sets]), sizes))
    shared = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(ids), GRAMS):
        width = min(GRAMS, len(ids) - begin)
        dense = []
        for row, gram, sizes in sides:
            part = (gram >= begin) & (gram < begin + width)
            dense.append(np.zeros((len(sizes), width), np.float32))
            dense[-1][row[part], gram[part] - begin] = 1
        shared += dense[0] @ dense[1].T
    return shared.astype(np.int32), (sides[0][2].astype(np.int32), sides[1][2].astype(np.int32))


def representatives(rows: DataFrame, key: str, subject: str, stem: str) -> DataFrame:
    """``key, representative`` for every row: the smallest key with its subject and stem; a null equals a null."""
    first = rows.groupBy(subject, stem).agg(F.min(key).alias("representative")).alias("f")
    r = rows.alias("r")
    same = F.col(f"r.{subject}").eqNullSafe(F.col(f"f.{subject}")) & F.col(f"r.{stem}").eqNullSafe(F.col(f"f.{stem}"))
    return r.join(first, same).select(F.col(f"r.{key}").alias(key), "representative")


def best_matches(pairs: DataFrame, members: DataFrame, key: str, most: int = MOST_MATCHES) -> DataFrame:
    """``a, b, exact, shared, total, rank``: for each row its ``most`` first copies, then its ``most`` most similar other rows.

    ``pairs`` are between representatives and ``members`` (key, representative)
    holds every row.  Copies are exact, share all and rank first; an exact match
    is never also a near one, since near pairs lie between classes.  Of each
    class only its ``most`` + 1 smallest keys can be named, and of each
    representative's partners only ``most`` classes, so rows stay in proportion
    to ``members``.
    """
    own = members.select(F.col(key).alias("a"), "representative")
    placed = F.row_number().over(Window.partitionBy("representative").orderBy("b"))
    firsts = members.select(F.col(key).alias("b"), "representative").withColumn("place", placed).where(F.col("place") <= most + 1)
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.col("shared") / F.col("total")), "b"))
    one = F.lit(1).cast("long")
    exact = own.join(firsts, "representative").where("a <> b").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("n") <= most)
    exact = exact.select("a", "b", F.lit(True).alias("exact"), one.alias("shared"), one.alias("total"))
    both = pairs.select("a", "b", "shared", "total").union(pairs.select("b", "a", "shared", "total"))
    classes = both.withColumn("n", best("a")).where(F.col("n") <= most).select(F.col("a").alias("from"), F.col("b").alias("representative"), "shared", "total")
    near = classes.join(firsts, "representative").select("from", "b", "shared", "total").withColumn("n", best("from")).where(F.col("n") <= most)
    near = own.join(near.withColumnRenamed("from", "representative"), "representative").select("a", "b", F.lit(False).alias("exact"), "shared", "total")
    order = Window.partitionBy("a").orderBy(F.desc("exact"), F.desc(F.col("shared") / F.col("total")), "b")
    return exact.union(near).withColumn("rank", F.row_number().over(order))
