"""Tiles smaller than the images give the rows that SQL gives, and images with gaps find their neighbours by place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import rows_of, rows_of_sql
from tests.conftest import SF
from voxlake.operators import order, resample, stencil, tiles, transform
from voxlake.plans.registry import ORACLES, PLANS


@pytest.mark.parametrize("name", ["r_linear_nan_padding", "r_sinc", "r_cubic_3d", "r_grad_cubic", "r_psf", "c_label"])
def test_small_tiles_give_the_same_rows(spark, duck, monkeypatch, name):
    monkeypatch.setattr(tiles, "SIDES", {1: 5, 2: 3, 3: 2})
    assert rows_of(PLANS[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


def test_points_far_outside_and_undefined_ones(spark):
    image = transform.grid(spark, 6, 6).select(F.lit(1).alias("k"), "x", "y", (F.col("x") + 10 * F.col("y")).cast("double").alias("value"))
    points = spark.createDataFrame([(1, 0, 2.5, 3.0), (1, 1, -500.0, 1e6), (1, 2, float("nan"), 1.0), (2, 3, 1.0, 1.0), (1, 4, None, 1.0)], "k int, p int, px double, py double")
    got = {r.p: r.value for r in resample.resample(image, points, ["k"], ["x", "y"], ["p"], 1, -7.0).collect()}
    assert got[0] == 32.5 and got[1] == -7.0 and np.isnan(got[2]) and np.isnan(got[4]) and got[3] == -7.0
    assert resample.resample(image.where("false"), points, ["k"], ["x", "y"], ["p"], 3).count() == 5
    assert resample.resample(image, points.where("false"), ["k"], ["x", "y"], ["p"], 0).count() == 0


def test_gaps_are_no_neighbours(spark):
    line = spark.createDataFrame([(0, x, float(x * x)) for x in (0, 1, 2, 5, 6)], "k int, x int, value double")
    got = {r.x: r.gx for r in stencil.gradient(line, ["k"], ["x"], 100.0).collect()}
    assert got == {0: (1 - 100) / 2, 1: 2.0, 2: (100 - 1) / 2, 5: (36 - 100) / 2, 6: (100 - 25) / 2}
    mean = {r.x: r.value for r in stencil.convolve(line, ["k"], ["x"], {"x": -1.0}, "mean").collect()}
    assert mean[2] == 2.5 and mean[5] == 30.5


@pytest.mark.parametrize("bins", [4096, 3])
def test_order_statistics_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(order, "BINS", bins)
    rng = np.random.default_rng(1)
    values = {k: np.round(rng.standard_normal(n), 2) * s for k, n, s in ((1, 300, 1.0), (2, 1, 5.0), (3, 40, 0.0))}
    values[1][7] = 1e6
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [(1, float("nan")), (2, None)]
    df = spark.createDataFrame(rows, "k int, value double")
    got = {r.k: r for r in order.order_statistics(df, ["k"], "value", {"lo": lambda n: F.floor(n * 0.1), "hi": lambda n: n - 1, "none": lambda n: n}).collect()}
    for k, v in values.items():
        s = np.sort(v)
        assert (got[k].lo, got[k].hi, got[k].none) == (s[int(len(s) * 0.1)], s[-1], None)
    placed = order.ranks(df.withColumn("i", F.monotonically_increasing_id()), ["k"], "value", ["i"]).orderBy("k", "_rank").collect()
    for k, v in values.items():
        mine = [r for r in placed if r.k == k]
        assert [r["_rank"] for r in mine] == list(range(1, len(v) + 1)) and [r.value for r in mine] == np.sort(v).tolist()


def test_kernels_of_many_tiles_give_what_they_give_of_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, x, y, float(rng.normal())) for k in range(12) for x in range(5) for y in range(40) if rng.random() < 0.9]
    source = spark.createDataFrame(rows, "k long, x int, y int, value double")
    points = spark.createDataFrame([(i % 13, i, *rng.uniform(-2, 42, 2).tolist()) for i in range(600)], "k long, id long, px double, py double")
    called = spark.sparkContext.accumulator(0)

    def kernel(p, dense, origin, column, tile):
        called.add(1)
        values, there = dense
        at = (tile, *(np.floor(p) - origin).astype(int).T)
        assert (column("id") >= 0).all()
        return [np.where(there[at], values[at], -1.0)]

    seen, calls = [], []
    for cells in (1, tiles.CELLS):
        monkeypatch.setattr(tiles, "CELLS", cells)
        before = called.value
        got = tiles.on_tiles(points, source, ["k"], ["x", "y"], ["px", "py"], (0, 0), kernel, "value double", ["k", "id"], ["value"], many=True)
        seen.append(sorted((r.k, r.id, r.value) for r in got.collect()))
        calls.append(called.value - before)
    value = {(k, x, y): v for k, x, y, v in rows}
    want = sorted((r.k, r.id, value.get((r.k, int(np.floor(r.px)), int(np.floor(r.py))), -1.0)) for r in points.collect())
    assert seen[0] == seen[1] == want and calls[1] < calls[0] / 3
