import contextlib
import uuid

import numpy as np
import pytest

from examlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def brute(rows):
    """Plain whitening by a full eigenvalue decomposition: signs are free, so each component is returned as it is."""
    use = [(k, [float(np.float32(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in use), default=0)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (dim - len(v)) for _, v in use], dtype=np.int64).reshape(len(use), dim)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return [k for k, _ in use], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(e), e / (z * z).sum() * n


def check(spark, rows, tolerance=1e-9):
    df = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], SCHEMA)
    got = whitening.whiten(df).toPandas()
    keys, n, deviation, whitened, explained = brute(rows)
    assert len(got) == 4 * len(keys) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for k in range(4):
        part = got[got.component == k + 1].sort_values(["vec_id", "deviation"], kind="stable")
        order = np.lexsort((deviation, keys))
        assert part.vec_id.tolist() == [keys[i] for i in order] and part.deviation.tolist() == deviation[order].tolist()
        assert np.abs(part.explained - explained[k]).max() < 1e-12
        w = whitened[order, k]
        assert min(np.abs(part.whitened - w).max(), np.abs(part.whitened + w).max()) < tolerance


def vectors(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dim)) * spread).astype(np.float32).tolist()


def test_given_table(spark, sf):
    check(spark, [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_nulls_copies_and_rows_that_are_left_out(spark):
    r = vectors(1, 300, 12, np.linspace(0.2, 1, 12))
    rows = list(enumerate(r)) + [(900 + i, r[0]) for i in range(200)] + [(5, r[7]), (5, r[7])]
    check(spark, rows + [(700, None), (701, [1.0] * 11 + [None]), (702, [float("nan")] * 12), (703, [float("inf")] * 12), (704, [-0.0] * 12)])


def test_flat_spectrum_of_many_dimensions(spark):
    """More dimensions than directions of the block, and little between the components and the rest."""
    check(spark, list(enumerate(vectors(2, 3000, 90, np.r_[1.3, 1.25, 1.2, 1.16, np.full(86, 1.0)]))))


def test_one_direction_short_vectors_and_large_entries(spark):
    check(spark, [(i, v[: 5 + i % 3]) for i, v in enumerate(vectors(3, 200, 7, 1))])
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(20)], "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1} and abs(got.explained[0] - 1) < 1e-12 and abs(got.whitened.std(ddof=0) - 1) < 1e-12
    got = whitening.whiten(spark.createDataFrame([(None, [1e300, 1.0]), (2, [-1e14, 3.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")).toPandas()
    assert set(got.vec_id.dropna()) == {2, 3} and got.deviation.isna().all() and np.isfinite(got.whitened).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], SCHEMA)).count() == 0


def test_clusters_fill_the_block():
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.standard_normal((120, 120)))[0]
    values = np.r_[5.0, 4.0, 3.0, 3.0 - 1e-7, np.full(60, 2.9), np.linspace(1, 0, 56)]
    v = (q * values) @ q.T
    found, vectors = whitening.components(lambda b: v @ b, 120)
    assert np.abs(found - values[:4]).max() < 1e-12
    assert np.abs(np.abs((vectors * q[:, :4]).sum(0)) - 1).max() < 1e-12


@contextlib.contextmanager
def settings(spark, held):
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tasks_of(spark, work):
    """How many tasks Spark started for what ``work`` does."""
    name, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(name, name)
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    track = context.statusTracker()
    stages = {s for j in track.getJobIdsForGroup(name) for s in track.getJobInfo(j).stageIds}
    return sum(track.getStageInfo(s).numTasks for s in stages)


def test_tasks_of_a_pass_follow_the_vectors_and_not_the_shuffles(spark):
    """Some forty passes over a small table: tasks that find nothing to do would cost more than the work."""
    df = spark.createDataFrame(list(enumerate(vectors(5, 600, 40, np.linspace(0.2, 1, 40)))), "vec_id long, embedding array<float>")
    with settings(spark, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k"}):
        assert tasks_of(spark, lambda: whitening.whiten(df).collect()) < 12 * 64


def test_sums_of_many_tasks_meet_in_groups(spark, monkeypatch):
    """More tasks than blocks may reach the driver at once, with parts of the fit list that hold a few vectors."""
    monkeypatch.setattr(whitening, "ENTRIES", 100)
    monkeypatch.setattr(whitening, "GROUPS", 2)
    seen, summed = [], whitening.Moments.summed
    monkeypatch.setattr(whitening.Moments, "summed", lambda self, *a: seen.append(self.tasks) or summed(self, *a))
    rows = list(enumerate(vectors(6, 400, 12, np.linspace(0.2, 1, 12))))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        check(spark, rows + [(900 + i, rows[0][1]) for i in range(50)])
    assert min(seen) > 2
