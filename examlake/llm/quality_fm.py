"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

Pairwise interactions have low rank, so all of them cost time in proportion to
the number of features: half of the squared sum less the sum of squares, factor
by factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import SPACED, map_batches, mix64, texts_of, word_hashes

#: Buckets of hashed words, and of statistics behind them; factors.
WORDS, STATS, RANK = 1 << 15, 1 << 10, 6
#: Labelled rows that a fit reads at most.
MAX_ROWS = 12_000
EPOCHS, BATCH, RATE, RIDGE = 6, 64, 0.1, 2e-5
_SIZE = WORDS + STATS


def _count_of(raw: np.ndarray, inside: bytes) -> int:
    flags = np.zeros(256, bool)
    flags[list(inside)] = True
    return int(flags[raw].sum())


def statistics(text: bytes, words: np.ndarray, distinct: np.ndarray) -> list[float]:
    """Structure of a text and its metadata: sizes, repetition, symbols, case, lines."""
    raw = np.frombuffer(text, np.uint8)
    n, size = max(len(words), 1), max(len(raw), 1)
    triples = mix64(mix64(words[:-2]) + words[1:-1] * np.uint64(3)) + words[2:] if len(words) > 2 else words[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log2(len(words) + 1),
        np.log2(len(raw) + 1),
        10 * len(raw) / n / 10,
        20 * len(distinct) / n,
        20 * float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0,
        20 * (1 - len(np.unique(triples)) / max(len(triples), 1)) if len(triples) else 0.0,
        100 * _count_of(raw, b"#*$%&|<>") / size,
        100 * _count_of(raw, b"|") / size,
        100 * _count_of(raw, b"0123456789") / size,
        100 * _count_of(raw, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        100 * _count_of(raw, b".!?") / size,
        100 * _count_of(raw, b",;:") / size,
        20 * (1 - len(set(lines)) / len(lines)) if lines else 0.0,
        np.log2(len(lines) + 1),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: damped counts of hashed words with length 1 together, and each statistic's two nearest steps.

    An empty text has the statistics of nothing.
    """
    words = word_hashes(text, SPACED)
    distinct, counts = np.unique(words, return_counts=True)
    places, where = np.unique((distinct >> np.uint64(49)).astype(np.int64), return_inverse=True)
    values = np.log1p(np.bincount(where, counts)) if len(places) else np.empty(0)
    values = values / max(np.sqrt((values**2).sum()), 1e-9)
    stats = statistics(text, words, distinct)
    step = np.minimum(np.floor(stats), 60).astype(np.int64)
    share = np.clip(np.asarray(stats) - step, 0, 1)
    base = WORDS + 64 * np.arange(len(stats))
    return np.concatenate([places, base + step, base + step + 1]), np.concatenate([values, 0.5 * (1 - share), 0.5 * share])


@dataclass
class Machine:
    """Bias, one weight and RANK factors for each feature; ``slope`` and ``shift`` calibrate its output."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        inner = values[:, None] * self.factors[places]
        return self.bias + float(self.linear[places] @ values) + 0.5 * float((inner.sum(0) ** 2 - (inner**2).sum(0)).sum())

    def score(self, text: bytes) -> float:
        z = self.slope * self.raw(*features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def trained(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Adagrad on the logistic loss in small batches; the last tenth of the rows calibrates and never trains."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(rows))
    held, order = order[: len(rows) // 10], order[len(rows) // 10 :]
    m = Machine(float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))), np.zeros(_SIZE), draw.normal(0, 0.05, (_SIZE, RANK)))
    seen_linear, seen_factors, seen_bias = np.full(_SIZE, 1e-6), np.full((_SIZE, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        draw.shuffle(order)
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            sizes = np.array([len(rows[i][0]) for i in part])
            places, values = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            row = np.repeat(np.arange(len(part)), sizes)
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            inner = values[:, None] * m.factors[places]
            total = np.add.reduceat(inner, first, 0)
            z = m.bias + np.add.reduceat(m.linear[places] * values, first) + 0.5 * (total**2 - np.add.reduceat(inner**2, first, 0)).sum(1)
            slip = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            at, back = np.unique(places, return_inverse=True)
            d_linear = np.bincount(back, slip[row] * values) + RIDGE * m.linear[at]
            each = (slip[row] * values)[:, None] * (total[row] - inner)
            d_factors = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + RIDGE * m.factors[at]
            seen_linear[at] += d_linear**2
            seen_factors[at] += d_factors**2
            seen_bias += slip.sum() ** 2
            m.linear[at] -= RATE * d_linear / np.sqrt(seen_linear[at])
            m.factors[at] -= RATE * 0.2 * d_factors / np.sqrt(seen_factors[at])
            m.bias -= RATE * slip.sum() / np.sqrt(seen_bias)
    if len(held) >= 20 and 0 < labels[held].sum() < len(held):
        m.slope, m.shift = _calibrated(np.array([m.raw(*rows[i]) for i in held]), labels[held])
    return m


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    best = (np.inf, 1.0, 0.0)
    for slope in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0):
        for shift in np.linspace(-2, 2, 41):
            loss = np.log1p(np.exp(-np.clip((slope * z + shift) * (2 * y - 1), -30, 30))).mean() + 1e-3 * (slope - 1) ** 2 + 1e-3 * shift**2
            best = min(best, (float(loss), slope, float(shift)))
    return best[1:]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows, chosen by hash of their key; a label of one kind gives a constant score.

    A key with both labels counts as 1; of rows that repeat a key the first text by
    hash counts; null texts are empty ones.  Executors compute the sample's
    features; the driver holds those alone.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("key"), "key").limit(max_rows)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["y", "places", "values"])

    sample = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows, y = [], []
    for r in map_batches(sample.orderBy("key").drop("key"), read, "y int, places array<int>, values array<float>").toLocalIterator():
        rows.append((np.array(r["places"], np.int64), np.array(r["values"], np.float64)))
        y.append(r["y"])
    if not rows or len(set(y)) < 2:
        return Machine(4.0 if y and y[0] else -4.0, np.zeros(_SIZE), np.zeros((_SIZE, RANK)))
    return trained(rows, np.array(y, np.float64))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id") -> DataFrame:
    """``key, score`` of every row: the probability of label 1.  Null texts score as empty ones; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array([m.score(t) for t in texts_of(batch)], pa.float64())], [key, "score"])

    rows = docs.select(key, "text")
    return map_batches(rows, rate, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")
