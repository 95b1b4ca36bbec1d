"""Queries of resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import resample as r
from ..operators import stencil as c
from .points import ON
from .stencils import conv_sql
from .views import SQL_2D, SQL_3D, img2d, img3d

QUERIES = []
KEY, AXES = ["image_id"], ["x", "y"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def _points(a):
    """An affine map of the voxels: part of the points lie outside."""
    return a.withColumns({"px": F.col("x") * 0.9 + F.col("y") * 0.15 - 0.35, "py": F.col("y") * 1.1 - F.col("x") * 0.05 + 0.2}).select(*ON, "px", "py")


POINTS = "pts AS (SELECT image_id, x, y, x * 0.9::DOUBLE + y * 0.15::DOUBLE - 0.35::DOUBLE AS px, y * 1.1::DOUBLE - x * 0.05::DOUBLE + 0.2::DOUBLE AS py FROM img2d)"


def weights(order: int, f: str, i: str, d: bool = False) -> str:
    """SQL weight of tap i (from the first) at fraction f."""
    if order == 0:
        return f"(CASE WHEN ({f} >= 0.5) = ({i} = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE"
    if order == 1:
        return f"(CASE {i} WHEN 0 THEN -1.0 ELSE 1.0 END)::DOUBLE" if d else f"(CASE {i} WHEN 0 THEN 1 - {f} ELSE {f} END)"
    if order == 3:
        if d:
            return f"(CASE {i} WHEN 0 THEN (4*{f} - 3*{f}*{f} - 1) / 2 WHEN 1 THEN (9*{f} - 10) * {f} / 2 WHEN 2 THEN (8*{f} - 9*{f}*{f} + 1) / 2 ELSE (3*{f} - 2) * {f} / 2 END)"
        return f"(CASE {i} WHEN 0 THEN {f} * ((2 - {f}) * {f} - 1) / 2 WHEN 1 THEN ({f}*{f} * (3*{f} - 5) + 2) / 2 WHEN 2 THEN {f} * ((4 - 3*{f}) * {f} + 1) / 2 ELSE ({f} - 1) * {f}*{f} / 2 END)"
    s = lambda k: f"(CASE WHEN {f} - ({k}) = 0 THEN 1 WHEN abs({f} - ({k})) >= 3 THEN 0 ELSE 3 * sin(pi() * ({f} - ({k}))) * sin(pi() * ({f} - ({k})) / 3) / pow(pi() * ({f} - ({k})), 2) END)"
    return f"({s(f'{i} - 2')} / ({' + '.join(s(k) for k in range(-2, 4))}))"


def sql(order: int, pad: str = "0", dx: bool = False, dy: bool = False) -> str:
    n, before = {0: (2, 0), 1: (2, 0), 3: (4, 1), 4: (6, 2)}[order]
    return f"SELECT p.image_id, p.x, p.y, sum(coalesce(s.value, {pad}) * {weights(order, '(px - floor(px))', 'i', dx)} * {weights(order, '(py - floor(py))', 'j', dy)}) AS value FROM pts p CROSS JOIN range({n}) a(i) CROSS JOIN range({n}) b(j) LEFT JOIN img2d s ON s.image_id = p.image_id AND s.x = floor(px) - {before} + i AND s.y = floor(py) - {before} + j GROUP BY p.image_id, p.x, p.y"


for _n, _o in (("nearest", 0), ("linear", 1), ("cubic", 3), ("sinc", 4)):
    q(f"r_{_n}", lambda s, d, o=_o: r.resample(img2d(s, d), _points(img2d(s, d)), KEY, AXES, AXES, o).select(*ON, r6("value").alias("value")), f"WITH {SQL_2D}, {POINTS}, g AS ({sql(_o)}) SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM g")
q("r_linear_nan_padding", lambda s, d: r.resample(img2d(s, d), _points(img2d(s, d)), KEY, AXES, AXES, 1, float("nan")).select(*ON, r6("value").alias("value")), f"WITH {SQL_2D}, {POINTS}, g AS ({sql(1, 'CAST(' + chr(39) + 'nan' + chr(39) + ' AS DOUBLE)')}) SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM g")
for _n, _o in (("linear", 1), ("cubic", 3)):
    q(
        f"r_grad_{_n}",
        lambda s, d, o=_o: r.image_gradient(img2d(s, d), _points(img2d(s, d)), KEY, AXES, AXES, o).select(*ON, r6("gx").alias("gx"), r6("gy").alias("gy")),
        f"WITH {SQL_2D}, {POINTS}, a AS ({sql(_o, dx=True)}), b AS ({sql(_o, dy=True)}) SELECT image_id, x, y, round(a.value, 6) + 0.0 AS gx, round(b.value, 6) + 0.0 AS gy FROM a JOIN b USING (image_id, x, y)",
    )
q(
    "r_linear_3d",
    lambda s, d: r.resample(img3d(s, d), img3d(s, d).withColumns({f"p{a}": F.col(a) * 0.8 + 0.3 for a in "xyz"}), KEY, ["x", "y", "z"], ["x", "y", "z"], 1).select("image_id", "x", "y", "z", r6("value").alias("value")),
    f"WITH {SQL_3D}, p AS (SELECT image_id, x, y, z, x * 0.8::DOUBLE + 0.3::DOUBLE AS px, y * 0.8::DOUBLE + 0.3::DOUBLE AS py, z * 0.8::DOUBLE + 0.3::DOUBLE AS pz FROM img3d) SELECT p.image_id, p.x, p.y, p.z, round(sum(coalesce(s.value, 0) * {weights(1, '(px - floor(px))', 'i')} * {weights(1, '(py - floor(py))', 'j')} * {weights(1, '(pz - floor(pz))', 'k')}), 6) + 0.0 AS value FROM p CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) CROSS JOIN range(2) c(k) LEFT JOIN img3d s ON s.image_id = p.image_id AND s.x = floor(px) + i AND s.y = floor(py) + j AND s.z = floor(pz) + k GROUP BY p.image_id, p.x, p.y, p.z",
)
q("r_downsample", lambda s, d: r.downsample(c.convolve(img2d(s, d), KEY, AXES, {"x": -0.7355, "y": -0.7355}), AXES).select(*ON, r6("value").alias("value")), f"SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, value FROM ({conv_sql('gauss', 0.7355, base=SQL_2D, source='img2d')}) WHERE x % 2 = 0 AND y % 2 = 0")
q(
    "r_pyramid",
    lambda s, d: r.pyramid(img2d(s, d), KEY, {"x": 8, "y": 8}, 2, smooth=False, least=4)[0][0].select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D} SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, round(value, 6) + 0.0 AS value FROM img2d WHERE x % 2 = 0 AND y % 2 = 0",
)
q(
    "r_change_resolution",
    lambda s, d: r.resample(img2d(s, d), r.new_grid_points(img2d(s, d), AXES, {"x": 1.25, "y": 1.5}, {"x": 0.125, "y": 0.25}), KEY, AXES, AXES, 1).select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D}, pts AS (SELECT image_id, x, y, x * 1.25::DOUBLE + 0.125::DOUBLE AS px, y * 1.5::DOUBLE + 0.25::DOUBLE AS py FROM img2d), g AS ({sql(1)}) SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM g",
)


def _psf_sql() -> str:
    return f"WITH {SQL_2D}, {POINTS}, e AS (SELECT image_id, x, y, px + a.i / 2.0::DOUBLE * 0.8::DOUBLE AS px, py + b.j / 2.0::DOUBLE * 0.5::DOUBLE AS py, exp(-0.125::DOUBLE * a.i * a.i) * exp(-0.125::DOUBLE * b.j * b.j) AS w FROM pts CROSS JOIN range(-4, 5) a(i) CROSS JOIN range(-4, 5) b(j)), t AS (SELECT e.image_id, e.x, e.y, s.value, w * {weights(1, '(px - floor(px))', 'i')} * {weights(1, '(py - floor(py))', 'j')} AS k FROM e CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) JOIN img2d s ON s.image_id = e.image_id AND s.x = floor(px) + i AND s.y = floor(py) + j) SELECT image_id, x, y, round(coalesce(sum(value * k) / nullif(sum(k), 0), CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM t GROUP BY ALL"


q("r_psf", lambda s, d: r.psf_resample(img2d(s, d), _points(img2d(s, d)), KEY, AXES, AXES, {"x": 0.8, "y": 0.5}).select(*ON, r6("value").alias("value")), _psf_sql())
