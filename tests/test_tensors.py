"""Tensor images at points against a plain version that takes one point and one voxel after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import convert, matrix, tensors, tiles, transform

AXES = ["x", "y", "z"]
AT = np.array([[0, 1, 3], [1, 2, 4], [3, 4, 5]])


def plain(image, p, j, world):
    total = np.zeros((3, 3))
    for step in np.ndindex(2, 2, 2):
        place = tuple((np.floor(p).astype(int) + step).tolist())
        k = np.prod([f if s else 1 - f for s, f in zip(step, p - np.floor(p), strict=True)])
        total += k * (matrix.logm(image[place][AT]) if place in image else 0.0)
    values, vectors = np.linalg.eigh(total)
    u, _, v = np.linalg.svd(world @ j @ np.linalg.inv(world))
    return (u @ v).T @ (vectors @ np.diag(np.exp(values)) @ vectors.T) @ (u @ v)


@pytest.mark.parametrize("side", [32, 2])
def test_tensors_of_any_direction(spark, monkeypatch, side):
    monkeypatch.setattr(tiles, "SIDES", dict.fromkeys((1, 2, 3), side))
    rng = np.random.default_rng(5)
    image = {}
    for place in np.ndindex(4, 4, 4):
        a = rng.normal(size=(3, 3))
        image[place] = (a @ a.T + 0.2 * np.eye(3))[[0, 0, 1, 0, 1, 2], [0, 1, 1, 2, 2, 2]]
    source = spark.createDataFrame([(0, *k, *v.tolist()) for k, v in image.items()], "k int, x int, y int, z int, " + ", ".join(f"d{i} double" for i in range(6)))
    p, j = rng.uniform(-0.8, 3.8, (40, 3)), np.eye(3) + rng.normal(0, 0.5, (40, 3, 3))
    names = [f"j{b}{a}" for b in "xyz" for a in "xyz"]
    rows = [(0, i, *p[i].tolist(), *j[i].ravel().tolist()) for i in range(40)] + [(0, 40, None, 1.0, 1.0, *np.eye(3).ravel().tolist()), (0, 41, 1.0, 1.0, 1.0, None, *np.eye(3).ravel().tolist()[1:])]
    points = spark.createDataFrame(rows, "k int, i int, px double, py double, pz double, " + ", ".join(f"{n} double" for n in names))
    world = np.diag([1.0, 2.0, 0.5, 1.0])
    got = {r.i: np.array([r[f"d{c}"] for c in range(6)], float) for r in tensors.resample_tensors(source, points, ["k"], AXES, ["i"], world=world.ravel().tolist()).collect()}
    assert len(got) == 42 and np.isnan(got[40]).all() and np.isnan(got[41]).all()
    for i in range(40):
        assert np.allclose(got[i][AT], plain(image, p[i], j[i], world[:3, :3]), atol=1e-8)
    assert tensors.resample_tensors(source.where("false"), points.where("i < 40"), ["k"], AXES, ["i"]).count() == 40


def test_a_turned_image_turns_its_tensors(spark):
    # every tensor points along x; the transformation reads the image a quarter turned about z, so they point along y
    voxels = transform.grid(spark, 5, 5, 5).select(F.lit(0).alias("k"), *AXES)
    source = voxels.select("*", *[F.lit(v).alias(f"d{i}") for i, v in enumerate((9.0, 0.0, 1.0, 0.0, 0.0, 1.0))])
    turn = convert.Transformation("affine", [0, -1, 0, 4, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1.0])
    got = tensors.transformed_tensors(turn, source, voxels, ["k"], AXES, dict.fromkeys(AXES, 5)).collect()
    assert len(got) == 125 and all(np.allclose([r[f"d{i}"] for i in range(6)], [1, 0, 9, 0, 0, 1], atol=1e-9) for r in got)
