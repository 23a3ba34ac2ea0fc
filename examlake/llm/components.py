"""Connected components of a link table by star contraction: joins and minima only, no node's links are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``): the smallest node that it reaches.

    Links may repeat, run either way or join a node to itself.  Each round
    points every node's larger neighbours, then its smaller ones, at the
    smallest; rounds grow with the logarithm of the longest chain.  Rounds are
    written to the shared folder.
    """
    edges = written(_down(links.where("a is not null and b is not null and a <> b")), "stars")
    state = _state(edges)
    while True:
        edges = written(_small(_large(edges)), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(links: DataFrame) -> DataFrame:
    edges = _down(links)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _down(moved.union(least.select("u", "m")))
