"""Queries of the voxel-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import NAN, r6
from ..operators import voxel
from .views import SQL_2D, SQL_3D, SQL_4D, img2d, img3d, img4d

ON = ["image_id", "x", "y"]


def _next(a):
    return a.withColumn("image_id", F.col("image_id") - 1)


def _out(a, *cols):
    return a.select(*(cols or ON), r6("value").alias("value"))


def _holes(a):
    """Every seventh voxel NaN: a small fixture with missing values."""
    return a.withColumn("value", F.when((F.col("x") + 3 * F.col("y") + F.col("image_id")) % 7 == 0, F.lit(NAN)).otherwise(F.col("value")))


HOLES = f"{SQL_2D}, holes AS (SELECT image_id, x, y, CASE WHEN (x + 3 * y + image_id) % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM img2d)"
PAIRS = f"{SQL_2D}, pairs AS (SELECT a.image_id, a.x, a.y, a.value, b.value AS w FROM img2d a JOIN img2d b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y)"
RANGES = f"{HOLES}, lim AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM holes WHERE NOT isnan(value) GROUP BY image_id)"
M = [2.0, 0.5, 0.0, -3.0, -0.25, 1.5, 0.0, 4.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0]

QUERIES = []


def q(name, fn, sql):
    QUERIES.append((name, fn, sql))


for _op, _sql in (("add", "v + w2"), ("sub", "v - w2"), ("mul", "v * w2"), ("div", "v / w2")):
    q(
        f"p_{_op}_images",
        lambda s, d, op=_op: _out(voxel.image_with_image(img2d(s, d), _next(img2d(s, d)), ON, op, 2.0, 0.5, 1.5, -0.25)),
        f"WITH {PAIRS}, s AS (SELECT *, value * 2.0 + 0.5 AS v, w * 1.5 - 0.25 AS w2 FROM pairs) SELECT image_id, x, y, round((({_sql}) - 0.5) / 2.0, 6) + 0.0 AS value FROM s",
    )
for _op, _sql in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    q(f"p_{_op}_value", lambda s, d, op=_op: _out(voxel.image_with_value(img2d(s, d), op, 1.75, 2.0, 0.5)), f"WITH {SQL_2D} SELECT image_id, x, y, round(((value * 2.0 + 0.5) {_sql} 1.75 - 0.5) / 2.0, 6) + 0.0 AS value FROM img2d")
q("p_scale", lambda s, d: _out(voxel.apply_scaling(img2d(s, d), 3.0, -1.0)), f"WITH {SQL_2D} SELECT image_id, x, y, round(value * 3.0 - 1.0, 6) + 0.0 AS value FROM img2d")
q("p_rescale", lambda s, d: _out(voxel.rescale(_holes(img2d(s, d)), ["image_id"], 2, 65)), f"WITH {RANGES} SELECT h.image_id, x, y, round((value - lo) / (hi - lo) * 63 + 2, 6) + 0.0 AS value FROM holes h JOIN lim USING (image_id)")
q("p_threshold", lambda s, d: _out(voxel.threshold(_holes(img2d(s, d)), -0.1, 0.1)), f"WITH {HOLES} SELECT image_id, x, y, round(CASE WHEN isnan(value) THEN value ELSE least(greatest(value, -0.1), 0.1) END, 6) + 0.0 AS value FROM holes")
q("p_cast_uint8", lambda s, d: _out(voxel.cast_type(voxel.apply_scaling(img2d(s, d), 400.0, 60.0), "uint8")), f"WITH {SQL_2D} SELECT image_id, x, y, round(trunc(least(greatest(value * 400.0 + 60.0, 0), 255)), 6) + 0.0 AS value FROM img2d")
q("p_binarise", lambda s, d: _out(voxel.binarise(_holes(voxel.cast_type(voxel.apply_scaling(img2d(s, d), 10.0, 0.0), "int16")))), f"WITH {HOLES} SELECT image_id, x, y, CASE WHEN isnan(value) THEN 1.0 WHEN trunc(value * 10.0) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM holes")
q("p_threshold_binarise", lambda s, d: _out(voxel.binarise_at(_holes(img2d(s, d)), 0.05)), f"WITH {HOLES} SELECT image_id, x, y, CASE WHEN NOT isnan(value) AND value < 0.05 THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM holes")
q(
    "f_mask_semi",
    lambda s, d: _out(voxel.within_mask(img2d(s, d), voxel.mask_of(voxel.binarise_at(_next(img2d(s, d)), 0.0)), ON)),
    f"WITH {PAIRS} SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM pairs WHERE w >= 0",
)
q(
    "p_nanmask",
    lambda s, d: _out(voxel.nan_outside(img2d(s, d), voxel.mask_of(voxel.binarise_at(_next(img2d(s, d)), 0.0)), ON)),
    f"WITH {PAIRS} SELECT i.image_id, i.x, i.y, round(CASE WHEN p.w >= 0 THEN i.value ELSE CAST('nan' AS DOUBLE) END, 6) + 0.0 AS value FROM img2d i LEFT JOIN pairs p USING (image_id, x, y)",
)
q(
    "p_drop_nan_from_mask",
    lambda s, d: voxel.drop_nan_from_mask(img4d(s, d).select("series_id", "x", "y").distinct(), img4d(s, d).withColumn("value", F.when((F.col("t") + F.col("x") + F.col("y") * F.col("series_id")) % 5 == 0, F.lit(NAN)).otherwise(F.col("value"))), ["series_id", "x", "y"]),
    f"WITH {SQL_4D} SELECT series_id, x, y FROM img4d GROUP BY ALL HAVING count(*) FILTER (WHERE (t + x + y * series_id) % 5 = 0) = 0",
)
q("p_rmnan", lambda s, d: _out(voxel.replace_nan_inf(_holes(img2d(s, d)), -9)), f"WITH {HOLES} SELECT image_id, x, y, round(CASE WHEN isnan(value) THEN -9 ELSE value END, 6) + 0.0 AS value FROM holes")
q(
    "p_robust_norm",
    lambda s, d: _out(voxel.robust_normalise(img2d(s, d), ["image_id"])),
    f"WITH {SQL_2D}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY value) - 1 AS r FROM img2d), l AS (SELECT image_id, max(value) FILTER (WHERE r = 1) AS lo, max(value) FILTER (WHERE r = 62) AS hi FROM r GROUP BY image_id) SELECT i.image_id, x, y, round((value - lo) / (hi - lo), 6) + 0.0 AS value FROM img2d i JOIN l USING (image_id)",
)
q("p_log", lambda s, d: _out(voxel.log_image(voxel.cut_fractions(voxel.apply_scaling(img2d(s, d), 20.0, 0.0)))), f"WITH {SQL_2D}, t AS (SELECT *, trunc(value * 20.0) AS v FROM img2d) SELECT image_id, x, y, round(CASE WHEN v < 0 THEN CAST('nan' AS DOUBLE) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(v) END, 6) + 0.0 AS value FROM t")
q(
    "p_4d_to_rgb",
    lambda s, d: voxel.channels_to_rgb(img4d(s, d), ["series_id", "x", "y"]),
    f"WITH {SQL_4D}, l AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM img4d GROUP BY 1), v AS (SELECT i.*, CAST(floor((value - lo) / (hi - lo) * 255 + 0.5) AS INT) AS v FROM img4d i JOIN l USING (series_id)) SELECT series_id, x, y, coalesce(max(v) FILTER (WHERE t = 0), 0) AS r, coalesce(max(v) FILTER (WHERE t = 1), 0) AS g, coalesce(max(v) FILTER (WHERE t = 2), 0) AS b FROM v GROUP BY ALL",
)
q(
    "p_signed_to_rgb",
    lambda s, d: voxel.signed_to_rgb(img2d(s, d), ["image_id"]),
    f"WITH {SQL_2D}, l AS (SELECT image_id, max(abs(value)) AS m FROM img2d GROUP BY 1), v AS (SELECT i.*, CAST(floor(abs(value) / m * 255 + 0.5) AS INT) AS v FROM img2d i JOIN l USING (image_id)) SELECT image_id, x, y, CASE WHEN value < 0 THEN v ELSE 0 END AS r, CASE WHEN value > 0 THEN v ELSE 0 END AS g, 0 AS b FROM v",
)
q(
    "p_def_to_disp",
    lambda s, d: voxel.displacement_of(img2d(s, d).withColumn("vx", F.col("value") + F.col("x")).withColumn("vy", F.col("value") * F.col("y")), M, ("x", "y", None)).select(*ON, r6("vx").alias("vx"), r6("vy").alias("vy")),
    f"WITH {SQL_2D} SELECT image_id, x, y, round(value + x - (2.0 * x + 0.5 * y - 3.0), 6) + 0.0 AS vx, round(value * y - (-0.25 * x + 1.5 * y + 4.0), 6) + 0.0 AS vy FROM img2d",
)
q(
    "p_disp_to_def",
    lambda s, d: voxel.deformation_of(img2d(s, d).withColumn("vx", F.col("value")).withColumn("vy", F.col("value") * 2), M, ("x", "y", None)).select(*ON, r6("vx").alias("vx"), r6("vy").alias("vy")),
    f"WITH {SQL_2D} SELECT image_id, x, y, round(value + (2.0 * x + 0.5 * y - 3.0), 6) + 0.0 AS vx, round(value * 2 + (-0.25 * x + 1.5 * y + 4.0), 6) + 0.0 AS vy FROM img2d",
)
q("p_zero_components", lambda s, d: voxel.zero_components(img2d(s, d).withColumn("vx", r6("value")).withColumn("vy", r6("value")), ["vy"]).select(*ON, "vx", "vy"), f"WITH {SQL_2D} SELECT image_id, x, y, round(value, 6) + 0.0 AS vx, CAST(0 AS DOUBLE) AS vy FROM img2d")
q("p_checker_lines", lambda s, d: voxel.checker_lines(s, (24, 20, 12), 5, ("x", "y")), "SELECT CAST(i % 24 AS INT) AS x, CAST(i // 24 % 20 AS INT) AS y, CAST(i // 480 AS INT) AS z, CASE WHEN i % 24 % 5 = 0 OR i // 24 % 20 % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM range(5760) t(i)")
q("p_identity_field", lambda s, d: voxel.identity_field(s, (9, 7, 5), M).select("x", "y", "z", *[r6(v).alias(v) for v in ("vx", "vy", "vz")]), "SELECT x, y, z, round(2.0 * x + 0.5 * y - 3.0, 6) + 0.0 AS vx, round(-0.25 * x + 1.5 * y + 4.0, 6) + 0.0 AS vy, round(z + 1.0, 6) + 0.0 AS vz FROM (SELECT CAST(i % 9 AS INT) AS x, CAST(i // 9 % 7 AS INT) AS y, CAST(i // 63 AS INT) AS z FROM range(315) t(i))")
q("p_slice", lambda s, d: img3d(s, d).where("z = 2").select("image_id", "x", "y", r6("value").alias("value")), f"WITH {SQL_3D} SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM img3d WHERE z = 2")
