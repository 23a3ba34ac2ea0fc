"""Language-model scoring over a subword lattice.

Pieces of an existing vocabulary weight every segmentation of a word; a forward
recursion in log space sums them all, so a text's score is its marginal
probability and not that of one segmentation.  The vocabulary's stored scores
are merge ranks and no probabilities, so each piece's probability is learned:
its relative frequency when the vocabulary segments all training words.  Every
distinct word is valued once; the values come back to the texts by a broadcast
of the frequent words and a join of the others.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import map_batches, texts_of, written
from examlake.llm.words import HEAD, count_pieces, head_of

_END = "end of text"


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased."""
    return text.lower().split()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(words: DataFrame, path: str) -> dict[str, int]:
    """How often each piece of the vocabulary stands in the training words (columns ``piece``, ``t``), each distinct word segmented once."""

    def segment(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: Counter[int] = Counter()
        found = vocabulary(path).encode([w.decode("utf-8", "replace") for w in batch.column("piece").to_pylist()], num_threads=1)
        for ids, t in zip(found, batch.column("t").to_pylist(), strict=True):
            for i in ids:
                held[i] += t
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array(held.values(), pa.int64())], ["id", "t"])

    counts = map_batches(words.where("t > 0").select("piece", "t"), segment, "id int, t long").groupBy("id").agg(F.sum("t").alias("t"))
    model = vocabulary(path)
    return {model.id_to_piece(r["id"]): r["t"] for r in counts.collect()}


class Lattice:
    """Log10 probabilities of pieces, smoothed by one count each, and the marginal of a word over all its segmentations."""

    def __init__(self, path: str, counts: dict[str, int], ends: int):
        model = vocabulary(path)
        usable = [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8]
        total = sum(counts.get(p, 0) + 1 for p in usable) + ends + 1
        self.scores = {p: math.log((counts.get(p, 0) + 1) / total) for p in usable}
        self.scores[_END] = math.log((ends + 1) / total)
        self.starts = {p[:n] for p in usable for n in range(1, len(p) + 1)}

    def end(self) -> float:
        return self.scores[_END] / math.log(10)

    def marginal(self, word: str) -> float:
        """Log10 of the summed probability of all segmentations of a word behind the vocabulary's word mark."""
        s = "▁" + word
        scores, starts = self.scores, self.starts
        into: list[list[float]] = [[] for _ in range(len(s) + 1)]
        into[0] = [0.0]
        for i in range(len(s)):
            here = into[i]
            if len(here) == 1:
                alpha = here[0]
            else:
                top = max(here)
                alpha = top + math.log(sum(math.exp(x - top) for x in here))
            into[i] = here[:1]
            single = s[i]
            if single not in scores:
                # A character without a piece of its own is spelt in the pieces of its bytes.
                into[i + 1].append(alpha + sum(scores[f"<0x{b:02X}>"] for b in single.encode("utf-8", "replace")))
            for j in range(i + 1, len(s) + 1):
                part = s[i:j]
                if part not in starts:
                    break
                if part in scores:
                    into[j].append(alpha + scores[part])
        top = max(into[-1])
        return (top + math.log(sum(math.exp(x - top) for x in into[-1]))) / math.log(10)


def score(docs: DataFrame, training: str, path: str, key: str = "doc_id", head: int = HEAD) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row; learns from rows whose boolean column ``training`` is true.

    ``base_score`` adds one to each count of the word unigram model; ``score``
    is log10 of the text's marginal probability over the lattice.  Null and
    empty texts are an end token alone.  Keys may repeat or be null; other
    columns are ignored.  Without training rows all counts are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(training), F.lit(False)).alias("chosen"), "text")
    counts = written(count_pieces(rows, words_of, "chosen"), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("t") > 0)).first()
    ends = rows.where("chosen").count()
    n, v = tokens + ends, distinct + (ends > 0)
    lattice = spark.sparkContext.broadcast(Lattice(path, piece_counts(counts, path), ends))
    end_base, end_score, smooth = math.log10(ends + 1), lattice.value.end(), math.log10(n + v + 1)

    def value(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = lattice.value.marginal
        marginal = [of(w.decode("utf-8", "replace")) for w in batch.column("piece").to_pylist()]
        base = np.log10(batch.column("t").to_numpy(zero_copy_only=False) + 1.0)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("piece", "n", "t")), pa.array(base), pa.array(marginal, pa.float64())], ["piece", "n", "t", "base", "marginal"])

    valued = written(map_batches(counts, value, "piece binary, n long, t long, base double, marginal double"), "word-values")
    often, seldom = head_of(valued, head)
    frame = often.select("piece", "t", "base", "marginal").toPandas()
    place = {bytes(w): i for i, w in enumerate(frame["piece"])}
    sums = np.vstack([frame["base"], frame["marginal"], frame["t"] > 0]).astype(np.float64) if len(frame) else np.zeros((3, 0))
    shared = spark.sparkContext.broadcast((place, np.hstack([sums, np.zeros((3, 1))])))

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, sums = shared.value
        size, known, base, marginal, rare = [], [], [], [], []
        for text in texts_of(batch):
            words = words_of(text)
            at = [place.get(w, -1) for w in words]
            b, m, k = sums[:, at].sum(1)
            size.append(len(words) + 1)
            known.append(int(k) + (ends > 0))
            base.append(b + end_base)
            marginal.append(m + end_score)
            rare.append([w for w, i in zip(words, at, strict=True) if i < 0])
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(marginal, pa.float64()), pa.array(rare, pa.list_(pa.binary()))], ["key", "n_tokens", "n_known", "base", "marginal", "rare"])

    found = map_batches(rows.select("key", "text"), look_up, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, n_known long, base double, marginal double, rare array<binary>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    more = found.select("row", F.explode("rare").alias("piece")).join(seldom, "piece").groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("marginal").alias("more_marginal"), F.count_if(F.col("t") > 0).alias("more_known"))
    out = found.drop("rare").join(more, "row", "left").na.fill(0, ["more_base", "more_marginal", "more_known"])
    return out.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("marginal") + F.col("more_marginal")).alias("score"),
    )
