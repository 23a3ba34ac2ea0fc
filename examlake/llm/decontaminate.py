"""Benchmark decontamination by winnowing.

A window is ten consecutive words of an item, or a shorter item whole.  Of every
six consecutive 5-grams, which are the ten words of one window, the one with the
least hash is kept as a fingerprint.  A window that stands in a document leaves
the same fingerprint there, so fingerprints join the two sides and only windows
around a joint fingerprint are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import LETTERS, gram_hashes, map_batches, mix64, texts_of, word_hashes, written

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Rows of the window table up to which it is broadcast, about 50 MB; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of the filter that keeps documents' other windows out of that shuffle, whatever the benchmark's size.
FILTER_BITS = 1 << 25
#: Parts into which the documents' rows fall where they meet the windows by shuffle.
SALTS = 16


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The places of the least hash of each ``span`` consecutive grams, each once, in order."""
    if len(grams) < span:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(windows.argmin(1) + np.arange(len(windows)))


def _hash_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[starts + i])
    return out


def candidates(words: np.ndarray, known, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hashes) of the document's windows that may be in the table.

    ``known`` says of an array of fingerprints, or of whole short windows, which
    may belong to items; ``lengths`` are the lengths of short items.
    """
    if len(words) >= WINDOW:
        grams = gram_hashes(words, GRAM)
        at = winnow(grams)
        at = at[known(grams[at], WINDOW)]
        if len(at):
            starts = np.unique((at[:, None] - np.arange(SPAN)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
            yield WINDOW, starts, _hash_at(words, starts, WINDOW)
    for n in lengths:
        hashes = gram_hashes(words, n)
        at = np.flatnonzero(known(hashes, n)) if len(hashes) else ()
        if len(at):
            yield n, at, hashes[at]


def window_table(items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(window, length, item)`` of the items' windows and ``(print, length)`` of their fingerprints, both distinct."""
    rows = items.select(F.col(key).alias("item"), "text").where("item is not null")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"length": [], "windows": [], "prints": []}
        for text in texts_of(batch):
            words = word_hashes(text, LETTERS)
            n = min(WINDOW, len(words))
            windows = np.unique(gram_hashes(words, n)) if n else words
            grams = gram_hashes(words, GRAM) if n == WINDOW else windows
            out["length"].append(n)
            out["windows"].append(windows.view(np.int64))
            out["prints"].append(np.unique(grams[winnow(grams)] if n == WINDOW else windows).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out["length"], pa.int32()), *(pa.array(out[k], pa.list_(pa.int64())) for k in ("windows", "prints"))], ["item", *out])

    read_items = map_batches(rows, read, f"item {rows.schema['item'].dataType.simpleString()}, length int, windows array<long>, prints array<long>")
    windows = written(read_items.select(F.explode("windows").alias("window"), "length", "item").distinct(), "windows")
    return windows, read_items.select(F.explode("prints").alias("print"), "length").distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``key, n_words, n_hit, items`` and the columns ``keep`` for every row of ``docs``: words, words inside an occurring window, and the sorted ids, as text, of items with one.

    Both frames need their key and ``text``; other columns are ignored.  Null
    and empty texts have no words and hit nothing; items without a key or words
    are in no document.  Keys may repeat or be null: each row follows its own text.
    """
    others = [c for c in keep if c != "text"]
    docs = docs.select(F.struct(F.col(key).alias("key"), *others).alias("own"), "text")
    windows, prints = window_table(items, item_key)
    carried = ["own", "text"] if "text" in keep else ["own"]
    found = _by_broadcast(docs, windows, prints, carried) if windows.count() <= broadcast_rows else _by_shuffle(docs, windows, prints, carried)
    return found.select(F.col("own.key").alias(key), *(F.col(f"own.{c}").alias(c) for c in others), *carried[1:], "n_words", "n_hit", "items")


def _kinds(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)


def _by_broadcast(docs: DataFrame, windows: DataFrame, prints: DataFrame, carried: list[str]) -> DataFrame:
    table = windows.select("length", "window", F.col("item").cast("string")).toPandas()
    held = {}
    for n, rows in table.groupby("length"):
        keys = rows["window"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        hashes, first = np.unique(keys[order], return_index=True)
        held[int(n)] = (hashes, [*first, len(keys)], rows["item"].to_numpy(object)[order])
    marks = {int(n): np.sort(rows["print"].to_numpy(np.int64).view(np.uint64)) for n, rows in prints.toPandas().groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast((held, marks))

    def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_, x)
        at[at == len(sorted_)] = 0
        return sorted_[at] == x

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, marks = shared.value
        none = np.empty(0, np.uint64)
        known = lambda x, n: member(marks[n], x) if n in marks else np.zeros(len(x), bool)
        out = {"n_words": [], "n_hit": [], "items": []}
        for text in texts_of(batch):
            words = word_hashes(text, LETTERS)
            depth, items = np.zeros(len(words) + 1, np.int64), set()
            for n, starts, hashes in candidates(words, known, [n for n in held if n < WINDOW]):
                keys, first, names = held.get(n, (none, [0], none))
                at = np.searchsorted(keys, hashes)
                real = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == hashes)
                np.add.at(depth, starts[real], 1)
                np.add.at(depth, starts[real] + n, -1)
                for i in np.unique(at[real]):
                    items.update(names[first[i] : first[i + 1]])
            out["n_words"].append(len(words))
            out["n_hit"].append(int((np.cumsum(depth) > 0).sum()))
            out["items"].append(sorted(items))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string()))], [*carried, *out])

    return map_batches(docs, search, f"{_kinds(docs, carried)}, n_words long, n_hit long, items array<string>")


def _bit(x: np.ndarray, n: int) -> np.ndarray:
    return (mix64(x + np.uint64(n)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(prints: DataFrame) -> np.ndarray:
    """A bit for each fingerprint, built in pieces of 8 KB on the executors: 4 MB whatever the benchmark's size."""

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, hashes = batch.column("length").to_numpy(zero_copy_only=False), batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.concatenate([_bit(hashes[lengths == n], int(n)) for n in np.unique(lengths)])
        return pa.RecordBatch.from_arrays([pa.array(at >> 16, pa.int64()), pa.array(at & 0xFFFF, pa.int64())], ["part", "bit"])

    def pack(part):
        import pandas as pd

        flags = np.zeros(1 << 16, np.uint8)
        flags[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [part["part"].iloc[0]], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((FILTER_BITS >> 16, 8192), np.uint8)
    for r in map_batches(prints, bits, "part long, bit long").distinct().groupBy("part").applyInPandas(pack, "part long, bits binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _by_shuffle(docs: DataFrame, windows: DataFrame, prints: DataFrame, carried: list[str]) -> DataFrame:
    lengths = [r["length"] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(_filter(prints))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = shared.value

        def known(x: np.ndarray, n: int) -> np.ndarray:
            at = _bit(x, n)
            return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

        sizes, found = [], {"length": [], "start": [], "window": []}
        ends = [0]
        for text in texts_of(batch):
            words = word_hashes(text, LETTERS)
            sizes.append(len(words))
            n = ends[-1]
            for length, starts, hashes in candidates(words, known, lengths):
                found["length"].append(np.full(len(starts), length, np.int32))
                found["start"].append(np.asarray(starts, np.int64))
                found["window"].append(hashes.view(np.int64))
                n += len(starts)
            ends.append(n)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int32() if k == "length" else pa.int64()) for k, v in found.items()], list(found))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*carried, "row")), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*carried, "row", "n_words", "found"])

    # Numbers of rows are written with what was found, so both sides of each later join have the same.
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    searched = written(map_batches(numbered, search, f"{_kinds(docs, carried)}, row long, n_words long, found array<struct<length int, start long, window long>>"), "searched")
    # Windows that very many documents hold are dealt over SALTS tasks, each with its own copy of the items' few rows.
    rows = searched.select("row", F.inline("found")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    dealt = windows.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    spans = rows.join(dealt.select("window", "length", "salt").distinct(), ["window", "length", "salt"], "left_semi").select("row", F.struct("start", (F.col("start") + F.col("length")).alias("stop")).alias("span"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to")), lambda a: a["n"])
    items = rows.join(dealt, ["window", "length", "salt"]).select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = spans.select("row", covered.alias("n_hit")).join(items, "row")
    return searched.select(*carried, "row", "n_words").join(hit, "row", "left").select(*carried, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
