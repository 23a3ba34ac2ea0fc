"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full shingle sets, and components.

Texts with equal shingle sets are one class from the start, so copies cost one
row each.  Class representatives meet in band buckets.  First every member is
held against its bucket's smallest document; where that leaves a bucket in
several components, all its pairs that still lie apart are compared, in blocks.
No pair that shares a bucket goes unchecked, and no bucket is gathered whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import map_batches, mix64, texts_of, written
from examlake.llm.linking import classes_of, digest_of, link, named, shingles

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: 40 bands of 5 ranks: a pair at the threshold shares no band with probability 2e-5.
BANDS, ROWS = 40, 5


def super_minhash(elements: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit elements, as m unsigned 64-bit values.

    Each element draws a random permutation of the m places; its draw of rank j
    there is j plus a uniform fraction, and a place keeps its smallest.  All
    elements advance rank by rank, and the first rank below which every place
    is filled ends the work: higher ranks cannot lower any place.
    """
    least = np.full(m, np.inf)
    small = np.uint8 if m <= 256 else np.uint16 if m <= 65536 else np.int64
    for begin in range(0, len(elements), 1 << 14):
        state = mix64(elements[begin : begin + (1 << 14)])
        n = np.arange(len(state))
        places, first = None, None
        for j in range(m):
            if j and least.max() < j:
                break
            state = state + np.uint64(0x9E3779B97F4A7C15)
            draw = mix64(state)
            k = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
            if j == 0:
                first = place = k
            else:
                if places is None:
                    places = np.tile(np.arange(m, dtype=small), (len(n), 1))
                    places[:, 0] = first
                    places[n, first] = 0
                place = places[n, k].astype(np.int64)
                places[n, k] = places[:, j]
            np.minimum.at(least, place, j + (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32)
    return least.view(np.uint64)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` places, different bands apart."""
    parts = signature.reshape(-1, rows)
    key = mix64(np.arange(len(parts), dtype=np.uint64) + np.uint64(1))
    for i in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, i])
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """``key, n, node, mark, bands``: set size, the two numbers of the set (null if empty) and its band keys."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, marks, keys = [], [], [], []
        for text in texts_of(batch):
            s = shingles(text, WORDS)
            sizes.append(len(s))
            node, mark = digest_of(s) if len(s) else (None, None)
            nodes.append(node)
            marks.append(mark)
            keys.append(bands(super_minhash(s)) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, pa.int64()) for x in (sizes, nodes, marks)), pa.array(keys, pa.list_(pa.int64()))], ["key", "n", "node", "mark", "bands"])

    return map_batches(docs, sign, f"key {docs.schema['key'].dataType.simpleString()}, n long, node long, mark long, bands array<long>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs`` (columns ``key`` and ``text``; others are ignored).

    Rows link where 100 * intersection >= percent * union of their 5-word shingle
    sets; ``component_id`` is the smallest key reachable and ``kept`` marks it.
    Below the usual percent the bands find a single pair less surely (0.72 at 50).
    Null and empty texts have no shingles and link with nothing.  Keys are meant
    to be unique; links hold between texts, so rows that repeat a key follow each
    its own text, and those of them that are their group's smallest are all
    kept.  A row without a key is linked with nothing, has no component and is
    kept.  Sets meet under 64-bit names, which join two unlike ones about once
    in ten billion documents.
    """
    docs = docs.select(F.col(key).alias("key"), "text")
    sets = written(signed(docs), "signed")
    classes = written(classes_of(sets, bands=F.min_by("bands", "key")), "classes")
    banded = classes.select("node", "rep", "n", F.explode("bands").alias("bucket"))
    # The smallest key is the likeliest original, to which all copies are close.
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("rep", "node"))["node"].alias("hub"), F.count("*").alias("members")).where("members > 1")
    meetings = written(banded.join(hubs, "bucket"), "meetings")
    sizes = meetings.where("node = hub").groupBy(F.col("node").alias("hub")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    pairs = meetings.where("node <> hub").groupBy("hub", "node").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = pairs.join(sizes, "hub").where(f"100 * most >= {percent} * lo and 100 * hi >= {percent} * least").select("hub", "node")
    out = named(sets, classes, link(docs, classes, meetings.select("bucket", "node", "rep"), written(pairs, "pairs"), WORDS, percent))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))
