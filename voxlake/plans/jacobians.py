"""Jacobian matrices, determinants and their logarithms of transformations of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert
from .transforms import _JAC, NODES, VOX, _spline, _voxels, field, nodes
from .velocities import _FLOW, _FORWARD, AXES, DIM, KEY, _products, flow, squared
from .views import SQL_2D, img2d

ON, QUERIES = [*KEY, *AXES], []
PARTS = ("jxx", "jxy", "jyx", "jyy")


def q(kind, data, source, spacing=1.0):
    """source: common table expressions, the last of them j with the four parts of the matrix."""

    def query(s, d):
        t = convert.Transformation(kind, data(s, d), spacing)
        voxels = _voxels(s, d) if "grid" in kind else img2d(s, d).select(*ON)
        found = convert.jacobian(t, voxels, KEY, AXES, DIM)
        return found.select(*ON, *[(F.round(c, 6) + 0.0).alias(c) for c in (*PARTS, "det", "log_det")])

    log = "CASE WHEN det < 0 THEN CAST('nan' AS DOUBLE) WHEN det = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(det) END"
    cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in (*PARTS, "det"))
    sql = f"WITH {source}, k AS (SELECT *, jxx * jyy - jxy * jyx AS det FROM j) SELECT image_id, x, y, {cols}, round({log}, 6) + 0.0 AS log_det FROM k"
    QUERIES.append((f"t_jacobian_of_{kind}", query, sql))


_AFFINE = [1.1, 0.2, 0.0, 0.5, -0.3, 0.9, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
q("affine", lambda s, d: _AFFINE, f"{SQL_2D}, j AS (SELECT image_id, x, y, 1.1::DOUBLE AS jxx, 0.2::DOUBLE AS jxy, -0.3::DOUBLE AS jyx, 0.9::DOUBLE AS jyy FROM img2d)")

_CUBIC = f"""{NODES}, {VOX}, a AS ({_spline(dx=True)}), b AS ({_spline(dy=True)}),
j AS (SELECT image_id, x, y, a.vx / 2 AS jxx, b.vx / 2 AS jxy, a.vy / 2 AS jyx, b.vy / 2 AS jyy FROM a JOIN b USING (image_id, x, y))"""
q("grid", lambda s, d: nodes(img2d(s, d)), _CUBIC, 2.0)

# slopes of the cell that a voxel lies in; its four corners are there for all voxels
_LINEAR = f"""{NODES}, {VOX}, p AS (SELECT *, x / 2.0::DOUBLE + 1 AS px, y / 2.0::DOUBLE + 1 AS py FROM v),
c AS (SELECT *, CAST(floor(px) AS INT) AS lx, CAST(floor(py) AS INT) AS ly FROM p),
w AS (
    SELECT c.image_id, c.x, c.y, n.vx, n.vy,
        CASE WHEN n.x = lx THEN -1 ELSE 1 END * CASE WHEN n.y = ly THEN 1 - (py - ly) ELSE py - ly END / 2 AS wx,
        CASE WHEN n.y = ly THEN -1 ELSE 1 END * CASE WHEN n.x = lx THEN 1 - (px - lx) ELSE px - lx END / 2 AS wy
    FROM c JOIN n ON n.image_id = c.image_id AND n.x IN (lx, lx + 1) AND n.y IN (ly, ly + 1)),
j AS (
    SELECT image_id, x, y, sum(vx * wx) AS jxx, sum(vx * wy) AS jxy, sum(vy * wx) AS jyx, sum(vy * wy) AS jyy
    FROM w GROUP BY image_id, x, y)"""
q("linear_grid", lambda s, d: nodes(img2d(s, d)), _LINEAR, 2.0)

q("deformation", lambda s, d: field(img2d(s, d)), _JAC)
q("displacement", lambda s, d: field(img2d(s, d)).withColumns({"vx": F.col("vx") - F.col("x"), "vy": F.col("vy") - F.col("y")}), _JAC)

_OF_FLOW = f"{squared(_FORWARD, 5)}, {_products(6)}, j AS (SELECT * FROM m5)"
q("flow", lambda s, d: flow(img2d(s, d)), f"{SQL_2D}, {_OF_FLOW}")
_OF_VELOCITY = f"{squared('SELECT image_id, x, y, x + vx / 64 AS vx, y + vy / 64 AS vy FROM g', 5)}, {_products(6)}, j AS (SELECT * FROM m5)"
q("velocity", lambda s, d: flow(img2d(s, d)), f"{_FLOW}, {_OF_VELOCITY}", 2.0)
