"""Token counts behind a digest cache.

A text's digest and the tokenizer's version name a stored count.  Texts whose
digest the cache lacks are encoded once for each distinct digest, and their
counts are appended.  The cache is a Parquet folder that later runs share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.bpe import chunks, encode_pieces, width
from examlake.llm.common import small_batches, texts_of

CACHE = "version string, digest string, n_bytes long, n_tokens long"
#: Chunks whose counts a Python worker remembers between batches and tasks, about 30 MB.
REMEMBERED = 200_000
_REMEMBERED: dict[str, dict[bytes, int]] = {}


def version_of(path: str) -> str:
    """The digest of the tokenizer's file: another vocabulary never finds these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: str = "text") -> F.Column:
    """The content that a digest names: byte-level ids depend on every byte, so only null is levelled, to empty."""
    return F.coalesce(F.col(text), F.lit(""))


def count_batch(texts: list[bytes], path: str) -> list[int]:
    """The number of ids of each text; chunks are encoded when this worker first meets them."""
    counts = _REMEMBERED.setdefault(path, {})
    size = int(width(path)[-1])
    out = []
    for text in texts:
        pieces = chunks(text, path)
        if new := [x for x in set(pieces) if x not in counts]:
            if len(counts) > REMEMBERED:
                counts.clear()
                new = list(set(pieces))
            counts.update(zip(new, (len(x) // size for x in encode_pieces(new, path)), strict=True))
        out.append(sum(map(counts.__getitem__, pieces)))
    return out


def count_tokens(docs: DataFrame, path: str, cache: str, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every row; ``cache`` is the folder of stored counts and gains what it lacked.

    ``key`` may repeat; other columns are ignored.  Null and empty texts have no
    tokens.  Equal texts are encoded once, whole, however many copies there are.
    A run that is repeated after a loss appends at most equal rows, and reading
    the cache takes one row for each digest.
    """
    spark, version = docs.sparkSession, version_of(path)
    rows = docs.select(F.col(key), normalised().alias("text")).withColumn("digest", F.sha2("text", 256))

    def stored() -> DataFrame:
        found = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        return found.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    small_batches(spark)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(map(len, texts), pa.int64()), pa.array(count_batch(texts, path), pa.int64())], ["digest", "n_bytes", "n_tokens"])

    # Equal texts meet once, by digest, after tasks have dropped their own copies; which of them have no count is settled on digests alone.
    misses = rows.select("digest").distinct().join(stored().select("digest"), "digest", "left_anti")
    texts = rows.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")
    new = texts.select("digest", "text").mapInArrow(encode, "digest string, n_bytes long, n_tokens long")
    new.select(F.lit(version).alias("version"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache)
    return rows.select(key, "digest").join(stored(), "digest").select(key, "n_bytes", "n_tokens")
