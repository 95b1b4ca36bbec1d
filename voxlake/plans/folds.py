"""Penalties, slopes and repair of folds of control grids at every voxel, and inverses of steep fields."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import inversion, penalty
from .transforms import AXES, KEY, NODES, VOX, _out, _spline, _voxels, basis, nodes
from .velocities import _FOLDED, folded, rounded
from .views import SQL_2D, img2d

QUERIES = []


def q(name, fn, sql):
    QUERIES.append((name, fn, sql))


# Jacobians of all voxels; a grid's nodes are two voxels apart
_DET = f"""{VOX}, a AS ({_spline(dx=True)}), b AS ({_spline(dy=True)}),
j AS (
    SELECT image_id, x, y, a.vx / 2 AS jxx, b.vx / 2 AS jxy, a.vy / 2 AS jyx, b.vy / 2 AS jyy,
        a.vx / 2 * b.vy / 2 - b.vx / 2 * a.vy / 2 AS det
    FROM a JOIN b USING (image_id, x, y))"""

q(
    "s_voxel_penalty",
    lambda s, d: _out(penalty.grid_penalty(nodes(img2d(s, d)), KEY, AXES, 2, _voxels(s, d)), "penalty", keys=KEY),
    f"""WITH {NODES}, {_DET}
SELECT image_id, round(CASE WHEN min(det) < 0 THEN CAST('nan' AS DOUBLE) ELSE avg(pow(ln(CASE WHEN det > 0 THEN det END), 2)) END, 6) + 0.0 AS penalty
FROM j GROUP BY 1""",
)


def _scattered(factor: str, where: str) -> str:
    """g: at each node that a voxel reaches the sums gx, gy over the voxels of the determinant's slopes times a factor."""
    fx, fy = "(x / 2.0::DOUBLE + 1 - floor(x / 2.0::DOUBLE + 1))", "(y / 2.0::DOUBLE + 1 - floor(y / 2.0::DOUBLE + 1))"
    return f"""w AS (
    SELECT image_id, CAST(floor(x / 2.0::DOUBLE + 1) - 1 + i AS INT) AS nx, CAST(floor(y / 2.0::DOUBLE + 1) - 1 + m AS INT) AS ny,
        {factor} * jxx AS kxx, {factor} * jxy AS kxy, {factor} * jyx AS kyx, {factor} * jyy AS kyy,
        {basis(fx, "i", True)} * {basis(fy, "m")} / 2 AS sx, {basis(fx, "i")} * {basis(fy, "m", True)} / 2 AS sy
    FROM j CROSS JOIN range(4) s(i) CROSS JOIN range(4) t(m) WHERE {where}),
g AS (SELECT image_id, nx AS x, ny AS y, sum(kyy * sx - kyx * sy) AS gx, sum(kxx * sy - kxy * sx) AS gy FROM w GROUP BY ALL)"""


q(
    "s_voxel_penalty_gradient",
    lambda s, d: _out(penalty.penalty_gradient(nodes(img2d(s, d)), KEY, AXES, 2, _voxels(s, d)), "vx", "vy"),
    f"""WITH {NODES}, {_DET}, {_scattered("2 * ln(det) / det", "det > 0")},
o AS (SELECT n.image_id, n.x, n.y, coalesce(gx, 0) / 81 AS vx, coalesce(gy, 0) / 81 AS vy FROM n LEFT JOIN g USING (image_id, x, y))
{rounded("o", "vx", "vy")}""",
)
q(
    "t_correct_voxel_folding",
    lambda s, d: _out(penalty.correct_folding(folded(img2d(s, d)), KEY, AXES, 2, _voxels(s, d)), "vx", "vy"),
    f"""WITH {_FOLDED}, {_DET}, {_scattered("1", "det <= 0")}, l AS (SELECT *, 5 * sqrt(gx * gx + gy * gy) AS l FROM g),
o AS (
    SELECT n.image_id, n.x, n.y, n.vx + coalesce(CASE WHEN l > 0 THEN gx / l END, 0) AS vx, n.vy + coalesce(CASE WHEN l > 0 THEN gy / l END, 0) AS vy
    FROM n LEFT JOIN l USING (image_id, x, y))
{rounded("o", "vx", "vy")}""",
)


def steep(a):
    """Each line of an image onto itself, monotone, with slopes that follow the values and often exceed 2, where a fixed
    point step leads away."""
    along = W.partitionBy("image_id", "y").orderBy("x")
    step = F.when(F.col("x") > 0, F.abs("value") + 0.02).otherwise(0.0)
    summed = a.withColumn("_c", F.sum(step).over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.max("_c").over(W.partitionBy("image_id", "y"))
    return summed.withColumn("_w", whole).select(*KEY, *AXES, (F.col("_c") * 7 / F.col("_w")).alias("vx"), F.col("y").cast("double").alias("vy"))


q(
    "t_inverse_field",
    lambda s, d: inversion.inverse_field(steep(img2d(s, d)), KEY, AXES, {"x": 8, "y": 8}, tolerance=1e-12).select(
        *KEY, *AXES, (F.round("vx", 4) + 0.0).alias("vx"), (F.round("vy", 4) + 0.0).alias("vy")
    ),
    f"""WITH {SQL_2D},
c AS (SELECT *, sum(CASE WHEN x > 0 THEN abs(value) + 0.02::DOUBLE ELSE 0 END) OVER (PARTITION BY image_id, y ORDER BY x) AS c FROM img2d),
f AS (SELECT image_id, x, y, c * 7 / max(c) OVER (PARTITION BY image_id, y) AS v FROM c),
e AS (SELECT *, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS ahead FROM f)
SELECT f.image_id, f.x, f.y,
    round(CASE WHEN f.x = 7 THEN 7 ELSE max(e.x + (f.x - e.v) / (e.ahead - e.v)) END, 4) + 0.0 AS vx, round(f.y::DOUBLE, 4) + 0.0 AS vy
FROM f LEFT JOIN e ON e.image_id = f.image_id AND e.y = f.y AND e.v <= f.x AND f.x < e.ahead
GROUP BY f.image_id, f.x, f.y""",
)
