"""What several operators share: the shared scratch folder, written intermediate tables, Arrow helpers and 64-bit hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes beyond which a word is hashed by BLAKE2b.
LONG_WORD = 256
#: Rows whose results a Python worker builds at once.
PART = 1000
#: ASCII space, tab, line feed, vertical tab, form feed, carriage return: what ``bytes.split()`` splits at.
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if spark.conf.get("spark.master", "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="examlake-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to PART rows and 8 MB, so that the JVM's and Python's buffers stay small beside long texts."""
    for key, most in (("maxRecordsPerBatch", PART), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        held = int(str(spark.conf.get(name)).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over batches that Spark has bounded in rows and bytes, PART rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PART):
                yield fn(batch.slice(begin, PART))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8 bytes, one after another; null is empty."""
    column = batch.column(name)
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def bucket_of(key: str, n: int) -> F.Column:
    """crc32 of the key as text, modulo n; the fold of a row without a key is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _table(inside: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, np.array([inside(i) for i in range(256)])


#: Byte tables: words between ASCII white space, and words of ASCII letters, digits and everything beyond ASCII.
SPACED = _table(lambda i: chr(i) not in WHITE or i > 127)
LETTERS = _table(lambda i: i > 127 or chr(i).isalnum())


def word_hashes(text: bytes, table: tuple[np.ndarray, np.ndarray] = SPACED) -> np.ndarray:
    """A 64-bit hash of each word of the text, ASCII letters lower-cased; words are the runs of bytes inside the table.

    Short words are hashed all at once by a polynomial modulo 2^64.  That polynomial
    has words of a thousand letters that collide whatever its base, so longer ones
    are hashed by BLAKE2b, one after another.
    """
    if not text:
        return np.empty(0, np.uint64)
    lower, inside = table
    raw = np.frombuffer(text, np.uint8)
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = inside[raw]
    edge = np.flatnonzero(np.diff(flags))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    found = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        found[i] = int.from_bytes(hashlib.blake2b(lower[raw[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return found


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return out
