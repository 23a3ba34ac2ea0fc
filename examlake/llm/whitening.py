"""Embedding whitening: the leading principal components of distinct vectors by Chebyshev-filtered subspace iteration, and every row projected on them.

The covariance is never formed.  A pass is one Spark job over the fit list: each
task multiplies its centred vectors with a block of directions, and Spark sums
the products.  On the driver stand only blocks of (dimension x directions)
numbers, whatever the number of rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import small_batches, written

#: Entries become whole numbers of this many to the unit.
SCALE = 256
#: Components returned, directions of the block beyond them, and the degree of a filter.
COMPONENTS, GUARD, DEGREE = 4, 28, 12
#: Steps that estimate the lower end of the spectrum, and most rounds of filter, QR and Rayleigh-Ritz.
LANCZOS, ROUNDS = 10, 80
#: An eigenvector is certified when its residual is below this part of the gap around its eigenvalue, or at the rounding of a pass.
CERTAIN, ROUNDING = 1e-12, 4e-15
#: An eigenvalue below this part of the first is zero: there is nothing to divide by.
NOTHING = 1e-12
#: Vectors of a packed row, entries for which the fit list gets a file, and most blocks of sums that reach the driver at once.
PACK, ENTRIES, GROUPS = 1024, 1 << 19, 32


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, x array<bigint>`` of the rows whose vector is there and holds only finite numbers."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(key).alias("key"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of int64, shorter ones filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == dim * len(column):
        return flat.astype(np.int64).reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    for i, part in enumerate(np.split(flat, ends[:-1])):
        out[i, : len(part)] = part
    return out


def _fit_list(x: DataFrame, dim: int, many: int) -> DataFrame:
    """The distinct ones of ``many`` vectors, many to a row in the narrowest integers that hold them: passes read few bytes and no lists.

    A pass costs a task and a file each part, so there are as many as the vectors fill, not as many as a shuffle has.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PACK):
                m = _matrix(batch.column("x").slice(begin, PACK), dim)
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary())], ["kind", "data"])

    # Vectors that differ only in trailing zeros are one vector of the whole dimension.
    full = F.expr(f"if(size(x) = {dim}, x, concat(x, array_repeat(0L, {dim} - size(x))))")
    parts = -(-many * dim // ENTRIES)
    return written(x.select(full.alias("x")).distinct().coalesce(parts).mapInArrow(pack, "kind string, data binary"), "fit-list")


class Moments:
    """Of the fit list: n, exact sums of each dimension, the trace of the covariance and its product with directions."""

    def __init__(self, packed: DataFrame, dim: int):
        self.packed, self.dim = packed, dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = 0, [0] * dim
            for m in _blocks(batches, dim):
                m = m.astype(object if np.abs(m.astype(np.float64)).max() >= 2.0**50 else np.int64)
                n, s = n + len(m), [a + int(b) for a, b in zip(s, m.sum(0), strict=True)]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(decimal.Decimal, s), pa.decimal128(38, 0))], ["i", "n", "s"])

        added = packed.mapInArrow(sums, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("tasks"))
        rows = sorted(added.collect(), key=lambda r: r["i"])
        self.n, self.tasks, self.sums = rows[0]["n"] if rows else 0, rows[0]["tasks"] if rows else 0, [int(r["s"]) for r in rows]
        self.mean = np.array([s / self.n for s in self.sums])

        self.trace = float(self.summed(lambda z: np.array([(z * z).sum()]), (1,))[0]) if self.n else 0.0

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions: one pass over the fit list."""
        return self.summed(lambda z: z.T @ (z @ block), block.shape)

    def summed(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The mean over the fit list of what ``of`` makes of centred vectors: tasks add their blocks, beyond GROUPS tasks groups of them theirs, the driver the rest."""
        dim, mean = self.dim, self.mean

        def row(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "v"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for m in _blocks(batches, dim):
                total = of(m - mean) if total is None else total + of(m - mean)
            if total is not None:
                yield row(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for v in batch.column("v"):
                    total = np.frombuffer(v.as_py()) if total is None else total + np.frombuffer(v.as_py())
            if total is not None:
                yield row(total)

        schema = "part int, v binary"
        blocks = self.packed.mapInArrow(work, schema)
        if self.tasks > GROUPS:
            blocks = blocks.repartition(GROUPS, "part").mapInArrow(add, schema)
        return np.sum([np.frombuffer(r["v"]) for r in blocks.collect()], 0).reshape(shape) / self.n

    def identity_error(self, directions: np.ndarray, values: np.ndarray) -> float:
        """The largest entry by which the covariance of the whitened fit list departs from the identity."""
        scale = directions / np.sqrt(values)
        centre = self.summed(lambda z: (z @ scale).sum(0), (len(values),))

        def second(z: np.ndarray) -> np.ndarray:
            w = z @ scale - centre
            return w.T @ w

        return float(np.abs(self.summed(second, (len(values),) * 2) - np.eye(len(values))).max())


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column("kind"), batch.column("data"), strict=True):
            yield np.frombuffer(data.as_py(), kind.as_py()).reshape(-1, dim)


def _lower_end(times, dim: int, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum, most likely: the least Ritz value of a few Lanczos steps less its residual, and no less than 0."""
    q, before, beta = rng.standard_normal(dim), np.zeros(dim), 0.0
    basis, a, b = [], [], []
    q /= np.linalg.norm(q)
    for _ in range(min(LANCZOS, dim)):
        basis.append(q)
        v = times(q[:, None])[:, 0] - beta * before
        a.append(float(q @ v))
        v -= a[-1] * q
        for u in basis:
            v -= (u @ v) * u
        beta = float(np.linalg.norm(v))
        b.append(beta)
        if beta <= 1e-12 * max(abs(x) for x in a):
            break
        before, q = q, v / beta
    ritz, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[: len(a) - 1], 1) + np.diag(b[: len(a) - 1], -1))
    return max(0.0, float(ritz[0] - b[-1] * abs(vectors[-1, 0])))


def _filtered(times, block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev recurrence: directions with eigenvalues in [low, high] shrink, those up to ``top`` grow."""
    e, c = (high - low) / 2, (high + low) / 2
    sigma = first = e / (top - c)
    y = (times(block) - c * block) * (sigma / e)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        block, y = y, 2 * (after / e) * (times(y) - c * y) - sigma * after * block
        sigma = after
    return y


def components(times, dim: int, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric operator behind ``times``.

    Filter, QR and Rayleigh-Ritz alternate until each residual is small against
    the gap to the nearest other eigenvalue, which bounds the vector's error, or
    has reached the rounding of a pass and falls no more.
    """
    rng = np.random.default_rng(seed)
    wanted, width = min(wanted, dim), min(dim, wanted + guard)
    block = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    low = _lower_end(times, dim, rng) if width < dim else 0.0
    best = np.inf
    for _ in range(ROUNDS):
        image = times(block)
        values, turn = np.linalg.eigh((m := block.T @ image) / 2 + m.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residual = np.linalg.norm(image - block * values, axis=0)[:wanted]
        apart = np.array([min([abs(values[i] - v) for j, v in enumerate(values) if j != i], default=values[0]) for i in range(wanted)])
        floor = ROUNDING * max(values[0], 0.0) * dim
        if width == dim or values[0] <= 0 or (residual <= np.maximum(CERTAIN * apart, floor)).all() or residual.max() <= 50 * floor and residual.max() > best / 2:
            break
        best = min(best, residual.max())
        high = max(float(values[-1]), low + 1e-3 * float(values[0] - low))
        if high >= values[wanted - 1]:  # a cluster fills the block: damp below it as far as the block can tell
            high = low + (float(values[wanted - 1]) - low) * 0.999
        block = np.linalg.qr(_filtered(times, block, degree, min(low, high * 0.999), high, float(values[0])))[0]
    return values[:wanted], block[:, :wanted]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out;
    extra columns are ignored; repeated and null keys stay row by row, and rows
    with one vector get the same numbers.  Entries beyond a long count as the
    longest one.  A vector shorter than the longest is filled with zeros.  Only
    components with a positive eigenvalue are returned, so a table without two
    different vectors, like an empty one, gives no rows.  ``deviation`` is exact,
    and null where it exceeds a long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = written(quantised(vectors, key, column), "quantised")
    schema = f"key {x.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    many, dim = x.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    moments = Moments(_fit_list(x, dim, many), dim) if dim else None
    if moments is None or moments.trace <= 0:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    values, directions = components(moments.times, dim, wanted)
    there = values > NOTHING * values[0]
    values, directions = values[there], directions[:, there]
    error, k, n, sums = moments.identity_error(directions, values), len(values), moments.n, moments.sums
    explained = values / moments.trace
    largest = (1 << 63) - 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sums, object)
        narrow = max(map(abs, sums)) < 1 << 61
        s = whole.astype(np.int64) if narrow else None
        for batch in batches:
            m = _matrix(batch.column("x"), dim)
            # int64 is exact where the sum of squares is surely below 2^63; other rows are worked out in Python's integers.
            reach = float(np.abs(m.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums))
            if narrow and reach * reach * dim < 2.0**62:
                d = n * m - s
                centred, deviation = d / n, (d * d).sum(1).tolist()
            else:
                d = n * m.astype(object) - whole
                centred, deviation = (d / n).astype(np.float64), (d * d).sum(1).tolist()
            w = (centred @ directions) / np.sqrt(values)
            many = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, n, np.int64)),
                    pa.array([v if v <= largest else None for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * k, error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(project, schema).withColumnRenamed("key", key)
