"""From meetings to components: texts whose shingle sets share a bucket are compared on their full sets, and links close to components.

A bucket is whatever makes its members worth comparing.  First each member is held
against its bucket's hub, then, where a bucket still lies in several components,
against a second one, and at last all pairs that still lie apart are compared in
blocks, buckets that share members in one.  No pair that shares a bucket goes
unchecked, and no bucket is gathered whole.  The sets of all members are written
once and read by every comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import SPACED, gram_hashes, map_batches, mix64, texts_of, word_hashes, written
from examlake.llm.components import components

#: Members of a hub that one sorted run compares, and members of a block.
RUN, BLOCK = 2000, 256
#: Members of a family of buckets that is compared as one, block by block.
FAMILY = 16 * BLOCK
#: Bits of the filter that keeps unwanted texts out of a shuffle.
FILTER = 1 << 24


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    words = word_hashes(text, SPACED)
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def digest_of(elements: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a set: the first is its node among the links, both together its class."""
    raw = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketch_of(elements: np.ndarray) -> bytes:
    """The parities of the elements' hash places, about four places an element: two sets differ in at least as many elements as their sketches differ in bits."""
    size = 1 << max(9, (4 * len(elements) - 1).bit_length())
    places = (mix64(elements) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8)).tobytes()


def _may_link(sizes: np.ndarray, comps: np.ndarray, sketches: list[bytes], sides: np.ndarray | None, percent: int) -> np.ndarray:
    """Which members of a group could be similar to one of another component, and of the other side where ``sides`` parts the group, as far as sketches and sizes tell."""
    words = [np.frombuffer(x, np.uint64) for x in sketches]
    width = min(map(len, words))
    for i, w in enumerate(words):
        while len(w) > width:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        words[i] = w
    rows = np.stack(words)
    may = np.zeros(len(rows), bool)
    for i in range(1, len(rows)):
        open_ = np.flatnonzero((comps[:i] != comps[i]) & (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & (sides[:i] != sides[i] if sides is not None else True))
        for begin in range(0, len(open_), 64):
            part = open_[begin : begin + 64]
            near = part[np.bitwise_count(rows[part] ^ rows[i]).sum(1) * (100 + percent) <= (sizes[part] + sizes[i]) * (100 - percent)]
            if len(near):
                may[near] = may[i] = True
    return may


def classes_of(signed: DataFrame, **more: F.Column) -> DataFrame:
    """``node, mark, n, rep``: texts with equal sets are one class, which its smallest key stands for; rows without a set or key are in none."""
    own = signed.where("node is not null and key is not null")
    return own.groupBy("node", "mark", "n").agg(F.min("key").alias("rep"), *(c.alias(k) for k, c in more.items()))


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, set, n, sketch``: the shingle sets of ``nodes``, read from the texts of their ``reps`` (node, key).

    Of rows that share a key only those with this very set are taken, repeats as
    often as they come.  Texts that may be wanted are shuffled once; what they meet
    grows with the corpus and is never broadcast.
    """

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words) for t in texts_of(batch)]
        right = [len(s) > 0 and digest_of(s)[0] == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s) for s in sets], pa.binary())], ["node", "set", "n", "sketch"]).filter(pa.array(right, pa.bool_()))

    wanted = written(reps.join(nodes, "node", "left_semi"), "wanted")
    return written(map_batches(_perhaps(docs, wanted).join(wanted.hint("merge"), "key").select("node", "text"), read, "node long, set binary, n long, sketch binary"), "sets")


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key may be among those of ``wanted``: all that are and few others, until there are about FILTER keys.

    The filter is FILTER bits, at most FILTER / 32 rows of 32 bits, whatever the
    tables; beyond about FILTER keys it lets every row through.
    """
    bit = F.pmod(F.xxhash64("key"), F.lit(FILTER))
    bits = wanted.select(F.shiftrightunsigned(bit, 5).cast("int").alias("at"), bit.alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("set"))
    met = docs.withColumn("bit", bit).withColumn("at", F.shiftrightunsigned("bit", 5).cast("int")).join(F.broadcast(words), "at")
    return met.where(F.expr("(shiftright(set, cast(bit & 31 as int)) & 1) = 1")).select(*docs.columns)


def _with_sets(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (node, g array<struct<...>>) with the shingle set of each node: one row for each element of g."""
    return sets.join(groups.hint("merge"), "node").select("node", "set", F.inline("g"))


def _near_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (hub, node) those that sizes and sketches leave open: full sets travel for these alone."""
    held = sets.select("node", "n", "sketch")
    met = pairs.join(held.hint("merge"), "node").join(held.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")).hint("merge"), "hub")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n", "hub_n", "sketch", "hub_sketch")), strict=True)
        may = [bool(_may_link(np.array([n, m]), np.arange(2), [a, b], None, percent).any()) for n, m, a, b in rows]
        return batch.select(["hub", "node"]).filter(pa.array(may, pa.bool_()))

    return map_batches(met, run, "hub long, node long")


def _star_links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (hub, node) those whose sets are similar, as links (a, b).

    A hub's members come in sorted runs of about RUN, each behind the hub's own
    set; a task holds one hub set and one member at a time.
    """
    pairs = written(_near_pairs(sets, pairs, percent), "near-pairs")
    runs = pairs.groupBy("hub").agg(F.expr(f"cast((count(*) + {RUN - 1}) div {RUN} as int)").alias("runs"))
    spread = pairs.join(runs, "hub").select("node", F.struct("hub", F.pmod(F.xxhash64("node"), "runs").cast("int").alias("run"), F.lit(1).alias("side")).alias("g"))
    hubs = runs.select(F.col("hub").alias("node"), F.explode(F.transform(F.expr("sequence(0, runs - 1)"), lambda r: F.struct("hub", r.alias("run"), F.lit(0).alias("side")))).alias("g"))
    rows = _with_sets(sets, written(spread.union(hubs).groupBy("node").agg(F.collect_list("g").alias("g")), "runs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            a, b = [], []
            for hub, run, side, node, data in zip(*(batch.column(c) for c in ("hub", "run", "side", "node", "set")), strict=True):
                now, s = (hub.as_py(), run.as_py()), np.frombuffer(data.as_py(), np.uint64)
                if now != at:
                    at, held = now, None
                if side.as_py() == 0:
                    held = s
                elif held is not None and similar(held, s, percent):
                    a.append(now[0])
                    b.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("hub", "run").sortWithinPartitions("hub", "run", "side").mapInArrow(compare, "a long, b long")


def _block_links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between members (bucket, node, comp) of a bucket that lie in different components.

    A bucket's members fall into blocks of about BLOCK; each pair of blocks is a
    group of its own.  First sketches meet, a sixteenth of a set's bytes, and name
    the members that may have a partner; these are then compared on their sets,
    as far as they are still apart, and the links that connect them passed on.
    """
    blocks = members.groupBy("bucket").agg(F.expr(f"cast((count(*) + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    spread = members.join(blocks, "bucket").withColumn("own", own)
    cell = F.transform(F.expr("sequence(0, blocks - 1)"), lambda j: F.struct("bucket", F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), "own", "comp"))
    cells = written(spread.select("node", F.explode(cell).alias("g")).select("node", "g.*"), "cells")
    near = written(_near(cells.join(sets.select("node", "n", "sketch").hint("merge"), "node"), percent), "near")
    rows = _with_sets(sets, near.groupBy("node").agg(F.collect_list(F.struct("bucket", "i", "j", "own", "comp")).alias("g")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            up = {c: c for *_, c in held}
            a, b = [], []

            def top(c):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            cross = at and at[1] != at[2]
            for x, (own, node, s, comp) in enumerate(held):
                for own2, node2, s2, comp2 in held[:x]:
                    if (not cross or own != own2) and top(comp) != top(comp2) and similar(s, s2, percent):
                        up[top(comp)] = top(comp2)
                        a.append(node)
                        b.append(node2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for bucket, i, j, own, node, comp, data in zip(*(batch.column(c) for c in ("bucket", "i", "j", "own", "node", "comp", "set")), strict=True):
                if (now := (bucket.as_py(), i.as_py(), j.as_py())) != at:
                    if held:
                        yield links()
                    at = now
                held.append((own.as_py(), node.as_py(), np.frombuffer(data.as_py(), np.uint64), comp.as_py()))
        if held:
            yield links()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a long, b long")


def _near(members: DataFrame, percent: int) -> DataFrame:
    """The members (node, bucket, i, j, own, comp, n, sketch) of pairs of blocks whose sketches leave them a partner: full sets travel for these alone."""
    names = ["node", "bucket", "i", "j", "own", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            sides = np.array(columns[4]) if at[1] != at[2] else None
            may = _may_link(np.array(columns[6]), np.array(columns[5]), columns[7], sides, percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:6], (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64()), strict=True)], names).filter(pa.array(may))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "n", "sketch")), strict=True):
                if row[1:4] != at:
                    if held:
                        yield found()
                    at = row[1:4]
                held.append(row)
        if held:
            yield found()

    return members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "node long, bucket long, i int, j int, own int, comp long")


def _second_links(sets: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Links to a second hub: the smallest member of each bucket that is not in its first hub's component meets the rest of them."""
    first = apart.groupBy("bucket").agg(F.min(F.struct("rep", "node", "comp")).alias("first"))
    rest = apart.join(first, "bucket").where("comp <> first.comp")
    second = rest.groupBy("bucket").agg(F.min(F.struct("rep", "node", "comp")).alias("second"))
    pairs = rest.join(second, "bucket").where("node <> second.node and comp <> second.comp").select(F.col("second.node").alias("hub"), "node").distinct()
    return _star_links(sets, written(pairs, "second-pairs"), percent)


def _apart(meetings: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, node, rep, comp) of the buckets that lie in several components; of buckets with the same members one is enough."""
    placed = meetings.join(comps.select("node", "component"), "node", "left").select("bucket", "node", "rep", F.coalesce("component", "node").alias("comp"))
    placed = written(placed.distinct(), "placed")
    found = placed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("first"), F.max("node").alias("last")).where("c > 2 and lo <> hi")
    found = found.groupBy("c", "x", "first", "last").agg(F.min("bucket").alias("bucket")).select("bucket")
    return written(placed.join(found, "bucket", "left_semi"), "apart")


def _families(apart: DataFrame) -> DataFrame:
    """``apart`` with buckets that reach each other through their members put together, where they have at most FAMILY members in all.

    A set then comes once for its family and not once for each of its buckets;
    members of a larger family stay in their buckets.
    """
    first = apart.groupBy("bucket").agg(F.min("node").alias("a"))
    family = components(apart.join(first, "bucket").select("a", F.col("node").alias("b"))).withColumnRenamed("component", "family")
    small = family.groupBy("family").agg(F.count("*").alias("size")).where(f"size <= {FAMILY}").select("family")
    placed = written(apart.select("bucket", "node", "comp").join(family.join(small.withColumn("small", F.lit(True)), "family", "left"), "node"), "families")
    return placed.where("small").select(F.col("family").alias("bucket"), "node", "comp").distinct().union(placed.where("small is null").select("bucket", "node", "comp"))


def link(docs: DataFrame, classes: DataFrame, meetings: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, component`` of the classes that link with others.

    ``meetings`` (bucket, node, rep) says who shares a bucket, ``pairs`` (hub, node)
    who is compared first; every member of a bucket of two or more must be in both.
    """
    reps = classes.groupBy("node").agg(F.min("rep").alias("key"))
    sets = _sets(docs, reps, meetings.select("node").distinct(), words)
    links = written(_star_links(sets, pairs, percent), "links")
    comps = components(links)
    apart = _apart(meetings, comps)
    if apart.take(1):
        second = written(_second_links(sets, apart, percent), "links")
        if second.take(1):
            links = links.union(second)
            comps = components(links)
            apart = _apart(meetings, comps)
        more = written(_block_links(sets, _families(apart), percent), "more-links")
        comps = components(links.union(more)) if more.take(1) else comps
    return comps


def named(signed: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """``key, n, component`` of every signed row: the smallest key that it reaches; null for a row without a key."""
    reps = classes.groupBy("node").agg(F.min("rep").alias("key"))
    linked = classes.select("node", "rep").join(comps, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    names = reps.join(linked.join(least, "component").select("node", "least").distinct(), "node", "left").select("node", F.coalesce("least", "key").alias("component"))
    out = signed.select("key", "n", "node").join(written(names, "named"), "node", "left")
    return out.select("key", "n", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
