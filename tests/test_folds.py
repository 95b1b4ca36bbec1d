"""Folds and penalties at voxels, and inverses of fields, against plain arrays and finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import inversion, penalty, tiles, transform

AXES = ["x", "y"]


def wavy(n, d, seed=2, size=0.3):
    rng = np.random.default_rng(seed)
    at = np.stack(np.meshgrid(*[np.arange(n)] * d, indexing="ij"), -1).reshape(-1, d)
    return [(0, *map(int, p), *((p - 1) * 2 + rng.uniform(-size, size, d)).tolist()) for p in at]


@pytest.mark.parametrize(("axes", "side"), [(["x", "y"], 32), (["x", "y"], 3), (["x", "y", "z"], 32)])
def test_slope_of_the_voxel_penalty(spark, monkeypatch, axes, side):
    monkeypatch.setattr(tiles, "SIDES", dict.fromkeys((1, 2, 3), side))
    d = len(axes)
    nodes = spark.createDataFrame(wavy(4 if d == 3 else 5, d), ", ".join(["k int", *[f"{a} int" for a in axes], *[f"v{a} double" for a in axes]]))
    voxels = transform.grid(spark, *(3 if a in axes else 1 for a in "xyz")).select(F.lit(0).alias("k"), *axes)

    def value(g, keys):
        everywhere = g.select(*keys).distinct().join(voxels.drop("k"))
        return penalty.grid_penalty(g, keys, axes, 2, everywhere).withColumnRenamed("penalty", "value")

    got = {tuple(r[a] for a in axes): [r[f"v{a}"] for a in axes] for r in penalty.penalty_gradient(nodes, ["k"], axes, 2, voxels).collect()}
    assert len(got) == nodes.count()
    for r in penalty.finite_differences(nodes, ["k"], axes, value, 1e-4).collect():
        assert np.allclose(got[tuple(r[a] for a in axes)], [r[f"v{a}"] for a in axes], atol=1e-6)


def test_no_folded_voxel_is_left(spark):
    rows = [(k, x, y, (x - 1) * 3.0 + (9.0 if k and (x, y) == (3, 3) else 0.0), (y - 1) * 3.0) for k in (0, 1) for x in range(7) for y in range(7)]
    nodes = spark.createDataFrame(rows, "k int, x int, y int, vx double, vy double")
    voxels = transform.grid(spark, 12, 12).select("x", "y").join(spark.range(2).selectExpr("CAST(id AS int) AS k"))
    folds = lambda g: transform.spline_jacobian(voxels, g, ["k"], AXES, 3).where("det <= 0").count()
    mended = penalty.unfold(nodes, ["k"], AXES, 3, 60, voxels)
    assert folds(nodes) > 0 and folds(mended) == 0
    assert sorted(tuple(r) for r in mended.where("k = 0").select("x", "y", "vx", "vy").collect()) == sorted(r[1:] for r in rows if r[0] == 0)


def test_simplex_finds_the_minimum_of_many_bowls():
    rng = np.random.default_rng(0)
    goal, stretch = rng.uniform(-5, 5, (200, 3)), rng.uniform(0.2, 9, (200, 3))
    found, cost = inversion.simplex(lambda i, y: (stretch[i] * (y - goal[i]) ** 2).sum(1), np.zeros((200, 3)), np.full(200, 2.0), 1e-14, 600)
    assert np.abs(found - goal).max() < 1e-5 and cost.max() < 1e-12


@pytest.mark.parametrize("halo", [8, 2])
def test_steep_fields_are_inverted(spark, halo):
    # slopes of 2.5 along x: every fixed point step leads away from the inverse, which is x / 2.5 and y + x / 2.5 less
    dim = {"x": 40, "y": 12}
    field = transform.grid(spark, 40, 12).select(F.lit(3).alias("k"), "x", "y", (F.col("x") * 2.5).alias("vx"), (F.col("y") + F.col("x") * 0.25).alias("vy"))
    got = inversion.inverse_field(field, ["k"], AXES, dim, halo=halo).collect()
    assert len(got) == 480 and max(r.residual for r in got) <= 1e-6
    assert all(abs(r.vx - r.x / 2.5) < 1e-6 and abs(r.vy - (r.y - r.x * 0.1)) < 1e-6 for r in got)
    plain = transform.invert_field(field, ["k"], AXES, dim, 8).where("x = 20 AND y = 6").first()
    assert abs(plain.vx - 8) > 1


def test_odd_fields(spark):
    dim = {"x": 6, "y": 6}
    voxels = transform.grid(spark, 6, 6).select(F.lit(1).alias("k"), "x", "y")
    still = voxels.withColumns({"vx": F.when((F.col("x") == 2) & (F.col("y") == 2), F.lit(None)).otherwise(F.col("x") + 0.5), "vy": F.col("y").cast("double")})
    got = {(r.x, r.y): r for r in inversion.inverse_field(still, ["k"], AXES, dim).collect()}
    assert len(got) == 36 and abs(got[0, 5].vx + 0.5) < 1e-9 and got[2, 2].residual == float("inf")
    assert inversion.inverse_field(still.where("false"), ["k"], AXES, dim).count() == 0
    flat = voxels.withColumns({"vx": F.lit(1.0), "vy": F.col("y").cast("double")})  # all of a line on one place
    ends = {r.x: r for r in inversion.inverse_field(flat, ["k"], AXES, dim).where("y = 3").collect()}
    assert ends[1].residual == 0 and abs(ends[4].vx - 8) < 1e-9
