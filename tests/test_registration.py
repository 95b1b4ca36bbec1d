import pytest
import numpy as np
from pyspark.sql import functions as F

from voxlake.operators import register, transform
from voxlake.plans.estimates import blob
from voxlake.streaming.ingest import windowed_statistics


def test_affine_registration_finds_a_shift(spark):
    m = register.affine_registration(blob(spark), blob(spark, dx=2.0, dy=-1.0), ["x", "y"], {"x": 32, "y": 32}, levels=1, rounds=2)
    assert np.allclose(m[:2, 3], [2, -1], atol=0.3) and np.allclose(m[:2, :2], np.eye(2), atol=0.05)


def test_spline_registration_improves(spark):
    ref, flo = blob(spark, 16), blob(spark, 16, dx=0.8)
    before = register.spline_registration(ref, flo, ["x", "y"], {"x": 16, "y": 16}, 5.0, rounds=0)[1]
    grid, after = register.spline_registration(ref, flo, ["x", "y"], {"x": 16, "y": 16}, 5.0, rounds=1)
    assert after > before and grid.count() == 7 * 7


def test_inverse_field_undoes_the_field(spark):
    f = transform.grid(spark, 12, 12).select(F.lit(0).alias("k"), "x", "y", (F.col("x") + F.sin(F.col("y") / 3.0) * 0.4).alias("vx"), (F.col("y") + F.cos(F.col("x") / 4.0) * 0.3).alias("vy"))
    dim = {"x": 12, "y": 12}
    both = transform.compose(f, transform.invert_field(f, ["k"], ["x", "y"], dim, 8), ["k"], ["x", "y"], dim)
    assert both.where("x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9").select(F.max(F.abs(F.col("vx") - F.col("x")))).first()[0] < 0.01


def test_squarings():
    assert transform.squarings_for(1.0, 3) == 6 and transform.squarings_for(100.0, 2) == 9


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_statistics(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == windowed_statistics(events, ["event_type"]).count()


@pytest.mark.parametrize("name", ["t_exponentiate", "t_invert_field", "t_velocity_field", "t_linear_spline_all"])
def test_all_images_and_voxels_are_processed(spark, name):
    from tests.conftest import SF
    from voxlake.plans.registry import PLANS
    from voxlake.plans.views import img2d

    want = {tuple(r) for r in img2d(spark, SF).select("image_id", "x", "y").collect()}
    rows = PLANS[name](spark, SF).collect()
    assert len(rows) == len(want) and {(r.image_id, r.x, r.y) for r in rows} == want
    if name == "t_linear_spline_all":
        e = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
        for r in rows:
            a, b = r.x / 2 + 1, r.y / 2 + 1
            x, y, v = int(a), int(b), 0.0
            for i in (0, 1):
                for j in (0, 1):
                    v += (e[r.image_id][y + j, x + i] + (x + i) * 2 - 2) * (a - x if i else 1 - a + x) * (b - y if j else 1 - b + y)
            assert abs(v - r.vx) < 2e-6


def test_all_images_are_averaged(spark):
    from tests.conftest import SF
    from voxlake.plans.registry import PLANS

    total = np.zeros((7, 7))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    for r in rows:
        e = np.array(r.embedding, float).reshape(8, 8)
        total += (e[:7, :7] * 0.75 + e[:7, 1:] * 0.25) if r.vec_id % 2 else e[:7, :7]
    got = {(r.x, r.y): r.value for r in PLANS["w_average_all_images"](spark, SF).collect()}
    assert len(got) == 64 and all(np.isnan(got[k]) if 7 in k else abs(got[k] - total[k[1], k[0]] / len(rows)) < 2e-6 for k in got)


def test_spline_registration_of_other_measures_and_levels(spark):
    ref, flo = blob(spark, 32), blob(spark, 32, dx=1.5)
    mask = ref.where("x < 30").select("x", "y")
    start = register.spline_registration(ref, flo, ["x", "y"], {"x": 32, "y": 32}, 5.0, rounds=0, measure="nmi", mask=mask)[1]
    grid, after = register.spline_registration(ref, flo, ["x", "y"], {"x": 32, "y": 32}, 5.0, rounds=1, linear=0.001, jacobian=0.001, measure="nmi", mask=mask, levels=2, trials=2)
    assert after > start and grid.count() == 10 * 10


def test_velocity_registration_improves_both_directions(spark):
    ref, flo = blob(spark, 14), blob(spark, 14, dx=0.8)
    start = register.velocity_registration(ref, flo, ["x", "y"], {"x": 14, "y": 14}, 5.0, rounds=0, squarings=1)[1]
    grid, after = register.velocity_registration(ref, flo, ["x", "y"], {"x": 14, "y": 14}, 5.0, rounds=1, squarings=1, trials=3)
    assert after > start and grid.count() == 6 * 6 and grid.columns == ["x", "y", "vx", "vy"]


def test_groups_and_series_are_aligned(spark):
    shifts = [-1.0, 1.0]
    one = lambda n, dx, name: blob(spark, 32, dx=dx).select(F.lit(n).alias(name), "x", "y", "value")
    images = one(0, shifts[0], "image_id").union(one(1, shifts[1], "image_id"))
    options = {"levels": 1, "rounds": 1, "rigid_only": True}
    mean, found = register.groupwise(images, ["x", "y"], {"x": 32, "y": 32}, 1, **options)
    assert mean.count() == 32 * 32 and found[1][0, 3] - found[0][0, 3] > 0.5
    series = register.pca_registration(images.withColumnRenamed("image_id", "t"), ["x", "y"], {"x": 32, "y": 32}, **options)
    assert series.count() == 2 * 32 * 32


def test_affine_registration_in_three_dimensions_with_masks(spark):
    def solid(dx):
        x, y, z = F.col("x") - dx, F.col("y"), F.col("z")
        v = 30 * F.sin(x / 2.1) * F.cos(y / 1.7) + 20 * F.sin(z / 1.9 + x / 5.0) + F.sin(x * y / 11.0) * 10
        return transform.grid(spark, 20, 20, 16).select("x", "y", "z", v.alias("value"))

    mask = transform.grid(spark, 20, 20, 16).withColumn("active", F.col("z") < 14)
    options = {"levels": 1, "rounds": 1, "rigid_only": True}
    m = register.affine_registration(solid(0.0), solid(2.0), ["x", "y", "z"], {"x": 20, "y": 20, "z": 16}, reference_mask=mask, floating_mask=mask, thresholds=(-100.0, 100.0), **options)
    assert np.allclose(m[:3, 3], [2, 0, 0], atol=0.3) and np.allclose(m[:3, :3], np.eye(3), atol=0.05)


def test_search_starts_between_the_centres(spark):
    at = lambda c: transform.grid(spark, 32, 32).select("x", "y", F.exp(-((F.col("x") - c) ** 2 + (F.col("y") - 14) ** 2) / 40.0).alias("value"))
    m = register.affine_registration(at(10), at(19), ["x", "y"], {"x": 32, "y": 32}, levels=1, rounds=0, centred=True)
    assert np.allclose(m[:3, 3], [9, 0, 0], atol=0.3)  # the picture ends within the blob
    box = lambda lo: transform.grid(spark, 32, 32).withColumn("active", F.col("x").between(lo, lo + 4))
    m = register.affine_registration(at(10), at(19), ["x", "y"], {"x": 32, "y": 32}, levels=1, rounds=0, centred=True, reference_mask=box(3), floating_mask=box(9))
    assert np.allclose(m[:3, 3], [6, 0, 0], atol=1e-9)
