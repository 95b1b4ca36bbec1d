"""Tensor images led through transformations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import convert, tensors
from .transforms import _JAC, AXES, KEY, field
from .views import img2d


def _tensors(a):
    """A positive tensor at each voxel of every image, from its value v and the value w four voxels further in its line:
    no two commute, with z apart."""
    v = F.col("value")
    w = F.max("value").over(W.partitionBy(*KEY, "y", F.col("x") % 4).orderBy("x").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    zero = F.lit(0.0)
    parts = [v * v + (w - v) * (w - v) + 0.1, v * w + (w - v) * 0.3, w * w + 0.19, zero, zero, v * v + 1.0]
    return a.select(*KEY, *AXES, *[c.alias(f"d{k}") for k, c in enumerate(parts)])


def _transformed(s, d):
    a = img2d(s, d)
    t = convert.Transformation("deformation", field(a))
    got = tensors.transformed_tensors(t, _tensors(a), a.select(*KEY, *AXES), KEY, AXES, {"x": 8, "y": 8})
    return got.select(*KEY, *AXES, *[r6(f"d{k}").alias(f"d{k}") for k in range(6)])


def _function(name: str, source: str, fn: str) -> str:
    """Table `name`: fn of the tensors' block in the plane, by its two eigenvalues, and of zz."""
    return f"""{name}e AS (SELECT *, (d0 + d2) / 2 AS mid, sqrt(pow((d0 - d2) / 2, 2) + d1 * d1) AS rad FROM {source}),
{name}f AS (SELECT *, ({fn}(mid + rad) + {fn}(mid - rad)) / 2 AS base, CASE WHEN rad > 0 THEN ({fn}(mid + rad) - {fn}(mid - rad)) / (2 * rad) ELSE 0 END AS k FROM {name}e),
{name} AS (SELECT image_id, x, y, base + k * (d0 - mid) AS d0, k * d1 AS d1, base + k * (d2 - mid) AS d2, {fn}(d5) AS d5 FROM {name}f)"""


# the nearest orthogonal matrix in the plane is a turn [c -s; s c] where the determinant is above 0, else [c s; s -c]
_SQL = f"""WITH {_JAC},
p AS (SELECT *, max(value) OVER (PARTITION BY image_id, y, x % 4) AS w FROM img2d),
t AS (
    SELECT image_id, x, y, value * value + (w - value) * (w - value) + 0.1::DOUBLE AS d0, value * w + (w - value) * 0.3::DOUBLE AS d1,
        w * w + 0.19::DOUBLE AS d2, value * value + 1 AS d5 FROM p),
{_function("l", "t", "ln")},
s AS (
    SELECT j.image_id, j.x, j.y, sum(coalesce(l.d0, 0) * k) AS d0, sum(coalesce(l.d1, 0) * k) AS d1, sum(coalesce(l.d2, 0) * k) AS d2, sum(coalesce(l.d5, 0) * k) AS d5
    FROM (
        SELECT j.image_id, j.x, j.y, floor(vx) + i AS gx, floor(vy) + m AS gy,
            CASE i WHEN 0 THEN 1 - (vx - floor(vx)) ELSE vx - floor(vx) END * CASE m WHEN 0 THEN 1 - (vy - floor(vy)) ELSE vy - floor(vy) END AS k
        FROM j CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(m)) j
    LEFT JOIN l ON l.image_id = j.image_id AND l.x = gx AND l.y = gy GROUP BY ALL),
{_function("e", "s", "exp")},
r AS (
    SELECT image_id, x, y, CASE WHEN jxx * jyy - jxy * jyx > 0 THEN 1 ELSE -1 END AS side,
        CASE WHEN jxx * jyy - jxy * jyx > 0 THEN atan2(jyx - jxy, jxx + jyy) ELSE atan2(jyx + jxy, jxx - jyy) END AS angle FROM j),
q AS (SELECT e.*, cos(angle) AS qxx, -side * sin(angle) AS qxy, sin(angle) AS qyx, side * cos(angle) AS qyy FROM e JOIN r USING (image_id, x, y)),
o AS (
    SELECT image_id, x, y, qxx * (d0 * qxx + d1 * qyx) + qyx * (d1 * qxx + d2 * qyx) AS d0,
        qxx * (d0 * qxy + d1 * qyy) + qyx * (d1 * qxy + d2 * qyy) AS d1, qxy * (d0 * qxy + d1 * qyy) + qyy * (d1 * qxy + d2 * qyy) AS d2, d5 FROM q)
SELECT image_id, x, y, round(d0, 6) + 0.0 AS d0, round(d1, 6) + 0.0 AS d1, round(d2, 6) + 0.0 AS d2, 0.0::DOUBLE AS d3, 0.0::DOUBLE AS d4, round(d5, 6) + 0.0 AS d5 FROM o"""

QUERIES = [("w_transformed_tensors", _transformed, _SQL)]
