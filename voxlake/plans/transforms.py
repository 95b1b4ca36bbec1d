"""Queries of transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import transform as t
from .points import M, ON
from .views import SQL_2D, SQL_3D, img2d, img3d

QUERIES = []
KEY, AXES = ["image_id"], ["x", "y"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def _out(df, *cols, keys=ON):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def field(a):
    """A smooth map of each image onto itself, disturbed by its values."""
    return a.withColumns({"vx": F.col("x") * 0.95 + 0.6 + F.col("value"), "vy": F.col("y") * 1.05 - 0.4 - F.col("value")})


def nodes(a):
    """The images read as control grids with nodes two voxels apart: displacements of the size of the values."""
    return a.withColumns({"vx": F.col("value") + F.col("x") * 2 - 2, "vy": F.col("value") * 0.5 + F.col("y") * 2 - 2}).select(*ON, "vx", "vy")


FIELD = f"{SQL_2D}, f AS (SELECT image_id, x, y, x * 0.95::DOUBLE + 0.6::DOUBLE + value AS vx, y * 1.05::DOUBLE - 0.4::DOUBLE - value AS vy FROM img2d)"
NODES = f"{SQL_2D}, n AS (SELECT image_id, x, y, value + x * 2 - 2 AS vx, value * 0.5::DOUBLE + y * 2 - 2 AS vy FROM img2d)"
VOX = "v AS (SELECT DISTINCT image_id, CAST(i % 9 AS INT) AS x, CAST(i // 9 AS INT) AS y FROM img2d, range(81) t(i))"


def _voxels(s, d):
    return img2d(s, d).select("image_id").distinct().crossJoin(t.grid(s, 9, 9).select("x", "y"))


def basis(f: str, i: str, d: bool = False) -> str:
    if d:
        return f"(CASE {i} WHEN 0 THEN -pow(1 - {f}, 2) / 2 WHEN 1 THEN (3*{f}*{f} - 4*{f}) / 2 WHEN 2 THEN (-3*{f}*{f} + 2*{f} + 1) / 2 ELSE {f}*{f} / 2 END)"
    return f"(CASE {i} WHEN 0 THEN pow(1 - {f}, 3) / 6 WHEN 1 THEN (3*pow({f}, 3) - 6*{f}*{f} + 4) / 6 WHEN 2 THEN (-3*pow({f}, 3) + 3*{f}*{f} + 3*{f} + 1) / 6 ELSE pow({f}, 3) / 6 END)"


def _spline(dx=False, dy=False) -> str:
    fx, fy = "(v.x / 2.0::DOUBLE + 1 - floor(v.x / 2.0::DOUBLE + 1))", "(v.y / 2.0::DOUBLE + 1 - floor(v.y / 2.0::DOUBLE + 1))"
    k = f"{basis(fx, 'i', dx)} * {basis(fy, 'j', dy)}"
    return f"SELECT v.image_id, v.x, v.y, sum(n.vx * {k}) AS vx, sum(n.vy * {k}) AS vy FROM v CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j) JOIN n ON n.image_id = v.image_id AND n.x = floor(v.x / 2.0::DOUBLE + 1) - 1 + i AND n.y = floor(v.y / 2.0::DOUBLE + 1) - 1 + j GROUP BY ALL"


q("t_affine", lambda s, d: _out(t.affine_field(img2d(s, d), M, AXES), "vx", "vy"), f"WITH {SQL_2D} SELECT image_id, x, y, round(2.0 * x + 0.5 * y - 3.0, 6) + 0.0 AS vx, round(-0.25 * x + 1.5 * y + 4.0, 6) + 0.0 AS vy FROM img2d")
q("t_affine_composed", lambda s, d: _out(t.affine_after(field(img2d(s, d)), M, AXES), "vx", "vy"), f"WITH {FIELD} SELECT image_id, x, y, round(2.0 * vx + 0.5 * vy - 3.0, 6) + 0.0 AS vx, round(-0.25 * vx + 1.5 * vy + 4.0, 6) + 0.0 AS vy FROM f")
q("t_spline_field", lambda s, d: _out(t.spline_field(_voxels(s, d), nodes(img2d(s, d)), KEY, AXES, 2), "vx", "vy"), f"WITH {NODES}, {VOX}, g AS ({_spline()}) SELECT image_id, x, y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM g")
q(
    "t_spline_jacobian",
    lambda s, d: _out(t.spline_jacobian(_voxels(s, d), nodes(img2d(s, d)), KEY, AXES, 2), "jxx", "jxy", "jyx", "jyy", "det"),
    f"WITH {NODES}, {VOX}, a AS ({_spline(dx=True)}), b AS ({_spline(dy=True)}), j AS (SELECT image_id, x, y, a.vx / 2 AS jxx, b.vx / 2 AS jxy, a.vy / 2 AS jyx, b.vy / 2 AS jyy FROM a JOIN b USING (image_id, x, y)) SELECT image_id, x, y, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("jxx", "jxy", "jyx", "jyy")) + ", round(jxx * jyy - jxy * jyx, 6) + 0.0 AS det FROM j",
)
_JAC = f"{FIELD}, j AS (SELECT *, " + ", ".join(f"coalesce(lead({v}) OVER {w} - {v}, {v} - lag({v}) OVER {w}) AS j{b}{a}" for a, w in (("x", "wx"), ("y", "wy")) for b, v in (("x", "vx"), ("y", "vy"))) + " FROM f WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"
q("t_jacobian_det", lambda s, d: _out(t.field_jacobian(field(img2d(s, d)), KEY, AXES), "jxx", "jyy", "det"), f"WITH {_JAC} SELECT image_id, x, y, round(jxx, 6) + 0.0 AS jxx, round(jyy, 6) + 0.0 AS jyy, round(jxx * jyy - jxy * jyx, 6) + 0.0 AS det FROM j")
q("t_jacobian_log", lambda s, d: _out(t.log_determinant(t.field_jacobian(field(img2d(s, d)), KEY, AXES)), "log_det"), f"WITH {_JAC}, k AS (SELECT *, jxx * jyy - jxy * jyx AS det FROM j) SELECT image_id, x, y, round(CASE WHEN det < 0 THEN CAST('nan' AS DOUBLE) WHEN det = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(det) END, 6) + 0.0 AS log_det FROM k")
q(
    "t_jacobian_penalty",
    lambda s, d: _out(t.jacobian_penalty(t.field_jacobian(field(img2d(s, d)), KEY, AXES), KEY), "penalty", keys=KEY),
    f"WITH {_JAC}, k AS (SELECT image_id, jxx * jyy - jxy * jyx AS det FROM j) SELECT image_id, round(CASE WHEN min(det) < 0 THEN CAST('nan' AS DOUBLE) ELSE avg(pow(ln(CASE WHEN det > 0 THEN det END), 2)) END, 6) + 0.0 AS penalty FROM k GROUP BY 1",
)
_P = "p AS (SELECT image_id, x, y, vx AS qx, vy AS qy, least(greatest(vx, 0), 7) AS cx, least(greatest(vy, 0), 7) AS cy FROM f), l AS (SELECT *, least(floor(cx), 6) AS lx, least(floor(cy), 6) AS ly FROM p)"
_W = "(CASE i WHEN 0 THEN 1 - (cx - lx) ELSE cx - lx END) * (CASE j WHEN 0 THEN 1 - (cy - ly) ELSE cy - ly END)"
_COMP = f"SELECT l.image_id, l.x, l.y, sum(f.vx * {_W}) + max(qx - cx) AS vx, sum(f.vy * {_W}) + max(qy - cy) AS vy FROM l CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) JOIN f ON f.image_id = l.image_id AND f.x = lx + i AND f.y = ly + j GROUP BY ALL"
q("t_compose", lambda s, d: _out(t.compose(field(img2d(s, d)), field(img2d(s, d)), KEY, AXES, {"x": 8, "y": 8}), "vx", "vy"), f"WITH {FIELD}, {_P}, g AS ({_COMP}) SELECT image_id, x, y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM g")
q(
    "t_landmarks",
    lambda s, d: _out(t.map_landmarks(img2d(s, d).where("x < 7 AND y < 7").withColumns({"px": F.col("x") + 0.25, "py": F.col("y") + 0.5}), field(img2d(s, d)), KEY, AXES, AXES), "vx", "vy"),
    f"WITH {FIELD} SELECT a.image_id, a.x, a.y, round((a.vx * 0.75 + b.vx * 0.25) * 0.5 + (c.vx * 0.75 + e.vx * 0.25) * 0.5, 6) + 0.0 AS vx, round((a.vy * 0.75 + b.vy * 0.25) * 0.5 + (c.vy * 0.75 + e.vy * 0.25) * 0.5, 6) + 0.0 AS vy FROM f a JOIN f b ON b.image_id = a.image_id AND b.x = a.x + 1 AND b.y = a.y JOIN f c ON c.image_id = a.image_id AND c.x = a.x AND c.y = a.y + 1 JOIN f e ON e.image_id = a.image_id AND e.x = a.x + 1 AND e.y = a.y + 1",
)
q(
    "t_bending_energy",
    lambda s, d: _out(t.bending_energy(nodes(img2d(s, d)), KEY, AXES), "energy", keys=KEY),
    f"WITH {NODES}, k AS (SELECT n.image_id, n.x, n.y, "
    + ", ".join(f"sum(m.{v} * {w}) AS {v}_{k}" for v in ("vx", "vy") for k, w in (("xx", "CASE i WHEN 0 THEN -2 ELSE 1 END * CASE j WHEN 0 THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 6 END"), ("yy", "CASE j WHEN 0 THEN -2 ELSE 1 END * CASE i WHEN 0 THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 6 END"), ("xy", "i / 2.0::DOUBLE * j / 2.0::DOUBLE")))
    + " FROM n CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j) JOIN n m ON m.image_id = n.image_id AND m.x = n.x + i AND m.y = n.y + j WHERE n.x BETWEEN 1 AND 6 AND n.y BETWEEN 1 AND 6 GROUP BY ALL) SELECT image_id, round(sum(" + " + ".join(f"{v}_xx * {v}_xx + {v}_yy * {v}_yy + 2 * {v}_xy * {v}_xy" for v in ("vx", "vy")) + ") / 128, 6) + 0.0 AS energy FROM k GROUP BY 1",
)
q(
    "t_refine_grid",
    lambda s, d: _out(t.refine_grid(nodes(img2d(s, d)), KEY, AXES), "vx", "vy"),
    f"WITH {NODES}, w AS (SELECT * FROM (VALUES (-2, 0.125::DOUBLE), (-1, 0.5::DOUBLE), (0, 0.75::DOUBLE), (1, 0.5::DOUBLE), (2, 0.125::DOUBLE)) t(d, k)) SELECT image_id, CAST(x * 2 - 1 + a.d AS INT) AS x, CAST(y * 2 - 1 + b.d AS INT) AS y, round(sum(vx * a.k * b.k), 6) + 0.0 AS vx, round(sum(vy * a.k * b.k), 6) + 0.0 AS vy FROM n, w a, w b GROUP BY ALL",
)
_LM = "lm AS (SELECT image_id, x, y, x * 0.7::DOUBLE + 1.3::DOUBLE AS qx, y * 0.6::DOUBLE + 1.2::DOUBLE AS qy, x + value AS tx, y - value AS ty FROM img2d WHERE x = y)"
_LS = f"SELECT l.image_id, l.x, l.y, sum(n.vx * k) AS vx, sum(n.vy * k) AS vy FROM (SELECT *, {basis('(qx - floor(qx))', 'i')} * {basis('(qy - floor(qy))', 'j')} AS k FROM lm CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j)) l JOIN n ON n.image_id = l.image_id AND n.x = floor(qx) - 1 + i AND n.y = floor(qy) - 1 + j GROUP BY ALL HAVING count(*) = 16"


def _landmarks(a):
    return a.where("x = y").withColumns({"qx": F.col("x") * 0.7 + 1.3, "qy": F.col("y") * 0.6 + 1.2, "tx": F.col("x") + F.col("value"), "ty": F.col("y") - F.col("value")})


q("s_landmark", lambda s, d: _out(t.landmark_distance(_landmarks(img2d(s, d)), nodes(img2d(s, d)), KEY, AXES, AXES), "distance", keys=KEY), f"WITH {NODES}, {_LM}, s AS ({_LS}) SELECT s.image_id, round(sum(pow(vx - tx, 2) + pow(vy - ty, 2)), 6) + 0.0 AS distance FROM s JOIN lm USING (image_id, x, y) GROUP BY 1")
q(
    "s_landmark_gradient",
    lambda s, d: _out(t.landmark_gradient(_landmarks(img2d(s, d)), nodes(img2d(s, d)), KEY, AXES, AXES), "vx", "vy"),
    f"WITH {NODES}, {_LM}, s AS ({_LS}), e AS (SELECT lm.*, 2 * (vx - tx) AS ex, 2 * (vy - ty) AS ey FROM s JOIN lm USING (image_id, x, y)) SELECT image_id, CAST(floor(qx) - 1 + i AS INT) AS x, CAST(floor(qy) - 1 + j AS INT) AS y, round(sum(ex * {basis('(qx - floor(qx))', 'i')} * {basis('(qy - floor(qy))', 'j')}), 6) + 0.0 AS vx, round(sum(ey * {basis('(qx - floor(qx))', 'i')} * {basis('(qy - floor(qy))', 'j')}), 6) + 0.0 AS vy FROM e CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j) GROUP BY ALL",
)
q(
    "t_jacobian_3d",
    lambda s, d: t.field_jacobian(img3d(s, d).withColumns({"vx": F.col("x") + F.col("value"), "vy": F.col("y") - F.col("value"), "vz": F.col("z") + F.col("value") * 0.5}), KEY, ["x", "y", "z"]).select("image_id", "x", "y", "z", r6("det").alias("det")),
    f"WITH {SQL_3D}, f AS (SELECT image_id, x, y, z, x + value AS vx, y - value AS vy, z + value * 0.5::DOUBLE AS vz FROM img3d), j AS (SELECT *, "
    + ", ".join(f"coalesce(lead(v{b}) OVER w{a} - v{b}, v{b} - lag(v{b}) OVER w{a}) AS j{b}{a}" for a in "xyz" for b in "xyz")
    + " FROM f WINDOW wx AS (PARTITION BY image_id, y, z ORDER BY x), wy AS (PARTITION BY image_id, x, z ORDER BY y), wz AS (PARTITION BY image_id, x, y ORDER BY z)) SELECT image_id, x, y, z, round(jxx * (jyy * jzz - jyz * jzy) - jxy * (jyx * jzz - jyz * jzx) + jxz * (jyx * jzy - jyy * jzx), 6) + 0.0 AS det FROM j",
)
q(
    "t_to_nodes",
    lambda s, d: _out(t.to_nodes(field(img2d(s, d)), img2d(s, d), KEY, AXES, 1.5), "vx", "vy"),
    f"WITH {FIELD}, p AS (SELECT image_id, x, y, (x - 1) * 1.5::DOUBLE AS px, (y - 1) * 1.5::DOUBLE AS py FROM img2d), k AS (SELECT p.*, i, j, CASE i WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END * CASE j WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END AS w FROM p CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)) SELECT k.image_id, k.x, k.y, round(sum(coalesce(f.vx, 0) * 1.5 * w), 6) + 0.0 AS vx, round(sum(coalesce(f.vy, 0) * 1.5 * w), 6) + 0.0 AS vy FROM k LEFT JOIN f ON f.image_id = k.image_id AND f.x = floor(px) + i AND f.y = floor(py) + j GROUP BY ALL",
)
