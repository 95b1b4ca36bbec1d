"""Self-similarity descriptors against plain loops, on images with a gap and an undefined voxel."""

import math

import pytest
from pyspark.sql import functions as F

from tests.compare import rows_of, rows_of_sql
from tests.conftest import SF
from voxlake.operators import measures, stencil, tiles
from voxlake.plans.registry import ORACLES, PLANS

NAN = float("nan")
#: Two images: no voxel at (2, 1), NaN at (4, 4) of the second.
VOXELS = {(k, x, y): NAN if (k, x, y) == (2, 4, 4) else math.sin(3.1 * x + k) + 0.7 * math.cos(1.9 * y * k) + 0.1 * x * y for k in (1, 2) for x in range(6) for y in range(5) if (x, y) != (2, 1)}
MIND = [((0, 0), m) for m in ((-1, 0), (1, 0), (0, -1), (0, 1))]
SSC = [((s, 0), (0, t)) for s in (-1, 1) for t in (-1, 1)]


def images(spark):
    return spark.createDataFrame([(*at, v) for at, v in VOXELS.items()], "k int, x int, y int, value double")


def plain(moves):
    out, g = {}, dict(zip((-1, 0, 1), stencil.kernel("gauss", 0.5), strict=True))
    difference = lambda k, x, y, p, q: (VOXELS.get((k, x + p[0], y + p[1]), 0.0) - VOXELS.get((k, x + q[0], y + q[1]), 0.0)) ** 2
    for k, x, y in VOXELS:
        d = []
        for p, q in moves:
            raw = {at: difference(*at, p, q) for at in VOXELS if at[0] == k}
            known = [at for at in raw if raw[at] == raw[at] and abs(at[1] - x) <= 1 and abs(at[2] - y) <= 1]
            # passes go along x, then y, and a gap holds nothing between them
            way = {at: g[at[1] - x] * g[at[2] - y] for at in known if (k, x, at[2]) in VOXELS}
            d.append(sum(w * raw[at] for at, w in way.items()) / sum(way.values()) if raw[k, x, y] == raw[k, x, y] else NAN)
        mean = sum(d) / len(d)
        e = [math.exp(-v / (mean or 2.220446049250313e-16)) for v in d]
        out[k, x, y] = [v / max(e) for v in e]
    return out


def check_descriptor(spark, describe, moves):
    got = {(r.k, r.x, r.y): [r[f"d{i}"] for i in range(4)] for r in describe(images(spark), ["k"], ["x", "y"]).collect()}
    want = plain(moves)
    assert got.keys() == want.keys()
    for at, d in want.items():
        if any(math.isnan(v) for v in d):
            assert all(math.isnan(v) for v in got[at])
        else:
            assert got[at] == pytest.approx(d, abs=1e-9)
    assert 0 < sum(math.isnan(d[0]) for d in want.values()) < 8


def on_small_tiles(spark, duck, monkeypatch, name):
    monkeypatch.setattr(tiles, "SIDES", {1: 5, 2: 3, 3: 2})
    assert rows_of(PLANS[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


def test_mind_is_that_of_plain_loops(spark, duck, monkeypatch):
    check_descriptor(spark, stencil.mind, MIND)
    on_small_tiles(spark, duck, monkeypatch, "d_mind")


def test_context_is_that_of_plain_loops(spark, duck, monkeypatch):
    check_descriptor(spark, stencil.mind_ssc, SSC)
    on_small_tiles(spark, duck, monkeypatch, "d_mindssc")


def check_measure(spark, name, moves):
    d = plain(moves)
    pair = images(spark)
    both = pair.where("k = 1").join(pair.where("k = 2").select("x", "y", F.col("value").alias("w")), ["x", "y"])
    (row,) = measures.measure(name, both, ["k"], ["x", "y"]).collect()
    terms = [sum((p - q) ** 2 for p, q in zip(d[1, x, y], d[2, x, y], strict=True)) for k, x, y in VOXELS if k == 1]
    terms = [t for t in terms if t == t]
    assert row.measure == pytest.approx(-sum(terms) / len(terms), abs=1e-9)


def test_mind_measure_leaves_undefined_voxels_out(spark, duck, monkeypatch):
    check_measure(spark, "mind", MIND)
    on_small_tiles(spark, duck, monkeypatch, "a_mind_value")


def test_context_measure_leaves_undefined_voxels_out(spark, duck, monkeypatch):
    check_measure(spark, "mindssc", SSC)
    on_small_tiles(spark, duck, monkeypatch, "a_mindssc_value")


def test_mind_slopes_on_small_tiles(spark, duck, monkeypatch):
    on_small_tiles(spark, duck, monkeypatch, "e_mind_gradient")


def test_context_slopes_on_small_tiles(spark, duck, monkeypatch):
    on_small_tiles(spark, duck, monkeypatch, "e_mindssc_gradient")
