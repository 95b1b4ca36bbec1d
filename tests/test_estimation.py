"""Estimation, penalties, velocities and conversions against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from voxlake.operators import convert, estimate, matrices, matrix, measures, penalty, transform
from voxlake.plans.registry import PLANS
from voxlake.plans.views import img4d

AXES = ["x", "y"]


def plain_trimmed(r, w, keep, rounds=30, tolerance=0.001):
    fit = lambda a, b: np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0]
    now, last = fit(r, w), np.inf
    before = now
    for _ in range(rounds):
        e = ((np.c_[r, np.ones(len(r))] @ now - w) ** 2).sum(1)
        use = e <= np.sort(e)[keep - 1]
        if last - e[use].sum() < tolerance:
            return now if e[use].sum() <= last else before
        before, last = now, e[use].sum()
        now = fit(r[use], w[use])
    return now


def test_trimmed_fit_against_arrays_and_its_odd_cases(spark, monkeypatch):
    rng = np.random.default_rng(0)
    r = rng.uniform(-50, 50, (120, 2))
    w = r @ np.array([[1.1, 0.1], [-0.2, 0.9]]) + [3, -2] + rng.normal(0, 0.1, (120, 2))
    w[:40] += rng.uniform(-100, 100, (40, 2))
    names = "rx double, ry double, wx double, wy double"
    rows = np.c_[r, w].tolist()
    want = plain_trimmed(r, w, 60)
    for few in (1 << 14, 4):  # looked at one by one, and in finer bins
        monkeypatch.setattr(estimate, "FEW", few)
        monkeypatch.setattr(estimate, "BINS", 16)
        odd = rows + [[float("nan"), 0.0, 1.0, 2.0], [None, 1.0, 1.0, 1.0]]
        m = estimate.trimmed_fit(spark.createDataFrame(odd, names), 2, 50)
        assert np.allclose(m[:2, :2].T, want[:2], atol=1e-6) and np.allclose(m[:2, 3], want[2], atol=1e-6)
    for few_rows in (rows[:5], []):
        assert np.array_equal(estimate.trimmed_fit(spark.createDataFrame(few_rows, names), 2, 50), np.eye(4))


def test_unfolding_removes_folds(spark):
    nodes = transform.grid(spark, 7, 7).select(F.lit(0).alias("k"), "x", "y", ((F.col("x") - 1) * 2 + F.when((F.col("x") == 3) & (F.col("y") == 3), F.lit(9.0)).otherwise(F.lit(0.0))).alias("vx"), ((F.col("y") - 1) * 2.0).alias("vy"))
    folds = lambda g: penalty.node_jacobians(g, ["k"], AXES, 2).where("det <= 0").count()
    assert folds(nodes) > 0 and folds(penalty.unfold(nodes, ["k"], AXES, 2, 40)) == 0


def test_penalty_gradient_is_the_slope_of_the_penalty(spark):
    rng = np.random.default_rng(2)
    rows = [(0, x, y, (x - 1) * 2 + float(rng.uniform(-0.3, 0.3)), (y - 1) * 2 + float(rng.uniform(-0.3, 0.3))) for x in range(5) for y in range(5)]
    nodes = spark.createDataFrame(rows, "k int, x int, y int, vx double, vy double")
    got = {(r.x, r.y): (r.vx, r.vy) for r in penalty.penalty_gradient(nodes, ["k"], AXES, 2).collect()}
    value = lambda g, keys: penalty.grid_penalty(g, keys, AXES, 2).withColumnRenamed("penalty", "value")
    for r in penalty.finite_differences(nodes, ["k"], AXES, value, 1e-4).collect():
        # nine inner nodes of twenty-five
        assert np.allclose(got[r.x, r.y], (r.vx * 9 / 25, r.vy * 9 / 25), atol=1e-6)


def test_exponentiated_gradient_against_arrays(spark):
    rng = np.random.default_rng(4)
    n = 6
    g = rng.normal(0, 1, (n, n, 2))
    f = np.stack(np.meshgrid(np.arange(n), np.arange(n), indexing="ij"), -1) + rng.uniform(-0.4, 0.4, (n, n, 2))
    frame = lambda a: spark.createDataFrame([(0, x, y, float(a[x, y, 0]), float(a[x, y, 1])) for x in range(n) for y in range(n)], "k int, x int, y int, vx double, vy double")

    def sample(a, p):
        lo, out = np.floor(p).astype(int), np.zeros(2)
        for i in (0, 1):
            for j in (0, 1):
                q = lo + [i, j]
                if (q >= 0).all() and (q < n).all():
                    out += a[tuple(q)] * np.prod(np.where([i, j], p - lo, 1 - p + lo))
        return out

    now = g.copy()
    for _ in range(2):
        jac = np.zeros((n, n, 2, 2))
        for axis in (0, 1):
            d = np.diff(f, axis=axis)
            jac[..., axis] = np.concatenate([d, d[-1:] if axis == 0 else d[:, -1:]], axis)
        now = now + np.array([[jac[x, y].T @ sample(now, f[x, y]) for y in range(n)] for x in range(n)])
    for r in estimate.exponentiated_gradient(frame(g), [frame(f), frame(f)], ["k"], AXES).collect():
        assert np.allclose((r.vx, r.vy), now[r.x, r.y] / 4, atol=1e-9)


def test_two_parts_against_arrays(spark):
    a = img4d(spark, SF)
    got = {(r.series_id, r.t, r.x, r.y): r.value for r in estimate.project_over_time(a, ["series_id"], AXES, measures.time_covariance(a, ["series_id"], AXES), 2).collect()}
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for s in (0, 17):
        v = np.stack([e[4 * s + t] for t in range(4)])
        c = v - v.mean(1, keepdims=True)
        w, u = np.linalg.eigh(c @ c.T / 64)
        u = u[:, np.argsort(-w)[:2]]
        back = u @ u.T @ c + v.mean(1, keepdims=True)
        assert all(abs(back[t, p] - got[s, t, p % 8, p // 8]) < 1e-9 for t in range(4) for p in range(64))


def test_trimmed_means_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2, matrix.make_affine([0, 0, float(a)], [float(b), 0, 0], [1, 1, 1], [0, 0, 0]).ravel().tolist()) for k, (a, b) in enumerate(rng.uniform(-20, 20, (14, 2)))]
    got = {r.g: np.reshape(r.m, (4, 4)) for r in matrices.trimmed_mean(spark.createDataFrame(rows, "g int, m array<double>"), ["g"], 0.5, 3).collect()}
    for g in (0, 1):
        assert np.allclose(got[g], matrix.trimmed_mean([np.reshape(m, (4, 4)) for k, m in rows if k == g], 0.5, 3), atol=1e-8)
    assert [r.m for r in matrices.each(spark.createDataFrame([(0, None), (1, [float("nan")] * 16)], "g int, m array<double>"), np.linalg.inv).collect()] == [None, None]


def test_composition_of_any_two(spark):
    dim = {"x": 10, "y": 10}
    voxels = transform.grid(spark, 10, 10).select(F.lit(0).alias("k"), "x", "y")
    shift = convert.Transformation("affine", [1, 0, 0, 0.5, 0, 1, 0, -0.25, 0, 0, 1, 0, 0, 0, 0, 1])
    moved = convert.Transformation("displacement", voxels.select("k", "x", "y", F.lit(0.5).alias("vx"), F.lit(0.25).alias("vy")))
    grid = convert.Transformation("grid", transform.control_grid(spark, dim, 2).withColumn("k", F.lit(0)), 2.0)
    for second, first, x, y in ((shift, moved, 1.0, 0.0), (moved, shift, 1.0, 0.0), (grid, grid, 0.0, 0.0), (grid, moved, 0.5, 0.25)):
        both = convert.composed(second, first, voxels, ["k"], AXES, dim)
        at = convert.displacement(both, voxels, ["k"], AXES, dim).where("x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7").collect()
        assert len(at) == 36 and all(abs(r.vx - x) < 1e-9 and abs(r.vy - y) < 1e-9 for r in at)
    back = convert.inverted(moved, voxels, ["k"], AXES, dim, 5)
    assert all(abs(r.vx + 0.5) < 1e-9 for r in convert.displacement(back, voxels, ["k"], AXES, dim).where("x BETWEEN 2 AND 7").collect())
    with pytest.raises(ValueError):
        convert.Transformation("rotation", [])


def test_array_differences_are_finite_differences(spark, monkeypatch):
    rng = np.random.default_rng(6)
    whole = [(k, x, y, *rng.normal(0, 1, 2).tolist()) for k in (1, 2) for x in range(5) for y in range(2, 6)]
    rows = [r for r in whole if (r[0], r[1], r[2]) != (2, 4, 5)] + [(3, x, y, 1.0, 2.0) for x in range(2) for y in range(9)]
    nodes = spark.createDataFrame(rows, "k long, x int, y int, vx double, vy double")
    energy = lambda g, keys: transform.bending_energy(g, keys, AXES).withColumnRenamed("energy", "value")
    as_rows = lambda df: {(r.k, r.x, r.y): (round(r.vx, 9), round(r.vy, 9)) for r in df.collect()}
    want = as_rows(penalty.finite_differences(nodes, ["k"], AXES, energy, 0.5))
    for held in (penalty.HELD, 60):  # all copies of a grid in one task, and three at a time
        monkeypatch.setattr(penalty, "HELD", held)
        got = penalty.array_differences(nodes, ["k"], AXES, transform.bending_of_arrays, 0.5)
        assert as_rows(got) == want and len(want) == 39 == got.count()
    plan = PLANS["e_finite_differences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "_sign" not in plan  # no row for a copy's node


def test_nmi_gradient_meets_bins_without_a_row_for_each(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, *rng.uniform(2, 9, 2).tolist(), *rng.normal(0, 1, 2).tolist()) for k in (1, 2) for i in range(30)] + [(1, 30, float("nan"), 3.0, 1.0, 1.0)]
    pair = spark.createDataFrame(rows, "k long, id int, value double, w double, sx double, sy double")
    histogram = spark.createDataFrame(measures.joint_histogram(pair, ["k"], 12, exact=True).collect(), "k long, r int, f int, h double")
    df = estimate.nmi_gradient(pair, histogram, ["k"], AXES, ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    got = {(r.k, r.id): (r.gx, r.gy) for r in df.collect()}
    assert len(got) == 60
    b = lambda x: 2 / 3 - x * x + abs(x) ** 3 / 2 if abs(x) < 1 else max(0.0, 2 - abs(x)) ** 3 / 6
    slope = lambda x: (b(x + 1e-6) - b(x - 1e-6)) / 2e-6
    for k in (1, 2):
        h = np.zeros((12, 12))
        for r in histogram.where(F.col("k") == k).collect():
            h[r.r, r.f] = r.h
        p = h / h.sum()
        ln = lambda x: np.log(np.where(x > 0, x, 1.0))
        joint, sides = ln(p), ln(p.sum(1))[:, None] + ln(p.sum(0))[None]
        hrf, both = -(p * joint).sum(), -(p * sides).sum()
        for _, i, v, w, sx, sy in (r for r in rows if r[0] == k and r[1] < 30):
            g = sum(b(v - r) * slope(w - f) * (sides[r, f] - both / hrf * joint[r, f]) for r in range(12) for f in range(12) if p[r, f] > 0) / (hrf * h.sum())
            assert np.allclose(got[k, i], (g * sx, g * sy), atol=1e-6)
