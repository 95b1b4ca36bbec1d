"""Queries of velocity fields, control grids, fold repair and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import convert, estimate, penalty, register, regularise, transform
from .points import M, ON
from .regularisers import _WEIGHTS, _back, _inner
from .transforms import AXES, FIELD, KEY, NODES, _out, _spline, _voxels, VOX, basis, field, nodes
from .views import SQL_2D, SQL_3D, img2d, img3d

QUERIES = []
DIM = {"x": 8, "y": 8}


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def flow(a):
    """The images read as flows of displacements."""
    return a.select(*ON, F.col("value").alias("vx"), (-F.col("value")).alias("vy"))


_W = "(CASE i WHEN 0 THEN 1 - (cx - lx) ELSE cx - lx END) * (CASE j WHEN 0 THEN 1 - (cy - ly) ELSE cy - ly END)"


def squared(start: str, rounds: int) -> str:
    """f0 (the scaled deformation `start`), f1, ... fn: each the one before applied to itself."""
    out = [f"f0 AS MATERIALIZED ({start})"]
    for k in range(rounds):
        p = f"SELECT image_id, x, y, vx AS qx, vy AS qy, least(greatest(vx, 0), 7) AS cx, least(greatest(vy, 0), 7) AS cy FROM f{k}"
        out.append(f"f{k + 1} AS MATERIALIZED (WITH l AS (SELECT *, least(floor(cx), 6) AS lx, least(floor(cy), 6) AS ly FROM ({p})) SELECT l.image_id, l.x, l.y, sum(f.vx * {_W}) + max(qx - cx) AS vx, sum(f.vy * {_W}) + max(qy - cy) AS vy FROM l CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) JOIN f{k} f ON f.image_id = l.image_id AND f.x = lx + i AND f.y = ly + j GROUP BY ALL)")
    return ", ".join(out)


def rounded(source: str, *cols: str, keys: str = "image_id, x, y") -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols) + f" FROM {source}"


_SCALED = "SELECT image_id, x, y, x {s} value / 64 AS vx, y {t} value / 64 AS vy FROM img2d"
_FORWARD, _BACKWARD = _SCALED.format(s="+", t="-"), _SCALED.format(s="-", t="+")
_FLOW = f"{SQL_2D}, n AS (SELECT image_id, x, y, value AS vx, -value AS vy FROM img2d), v AS (SELECT image_id, x, y FROM img2d), g AS ({_spline()})"

q("t_exponentiate", lambda s, d: _out(transform.exponentiate(flow(img2d(s, d)), KEY, AXES, DIM), "vx", "vy"), f"WITH {SQL_2D}, {squared(_FORWARD, 6)} {rounded('f6', 'vx', 'vy')}")
q("t_exponentiate_backward", lambda s, d: _out(transform.exponentiate(flow(img2d(s, d)), KEY, AXES, DIM, backward=True), "vx", "vy"), f"WITH {SQL_2D}, {squared(_BACKWARD, 6)} {rounded('f6', 'vx', 'vy')}")
q("t_intermediate_field", lambda s, d: _out(transform.intermediate_fields(flow(img2d(s, d)), KEY, AXES, DIM)[3], "vx", "vy"), f"WITH {SQL_2D}, {squared(_FORWARD, 3)} {rounded('f3', 'vx', 'vy')}")
_PART = [1.02, 0.01, 0.0, 0.05, -0.01, 0.98, 0.0, -0.02, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
q(
    "t_exponentiate_affine_part",
    lambda s, d: _out(transform.exponentiate(flow(img2d(s, d)), KEY, AXES, DIM, 6, affine=_PART), "vx", "vy"),
    f"WITH {SQL_2D}, w AS (SELECT image_id, x, y, value, x * 0.02::DOUBLE + y * 0.01::DOUBLE + 0.05::DOUBLE AS ax, x * -0.01::DOUBLE + y * -0.02::DOUBLE - 0.02::DOUBLE AS ay FROM img2d), {squared('SELECT image_id, x, y, x + (value - ax) / 64 AS vx, y + (-value - ay) / 64 AS vy FROM w', 6)}, o AS (SELECT image_id, x, y, vx + ax AS vx, vy + ay AS vy FROM f6 JOIN w USING (image_id, x, y)) {rounded('o', 'vx', 'vy')}",
)
_VELOCITY = f"WITH {_FLOW}, {squared('SELECT image_id, x, y, x + vx / 64 AS vx, y + vy / 64 AS vy FROM g', 6)} {rounded('f6', 'vx', 'vy')}"
_velocity = lambda s, d, **o: convert.Transformation("velocity", flow(img2d(s, d)), 2.0, **o)
q("t_velocity_field", lambda s, d: _out(convert.deformation(_velocity(s, d), img2d(s, d).select(*ON), KEY, AXES, DIM), "vx", "vy"), _VELOCITY)
q("t_flow_of_velocity_grid", lambda s, d: _out(convert.flow(_velocity(s, d), img2d(s, d).select(*ON), KEY, AXES), "vx", "vy"), f"WITH {_FLOW} {rounded('g', 'vx', 'vy')}")
q(
    "t_invert_velocity",
    lambda s, d: _out(convert.deformation(convert.inverted(_velocity(s, d), img2d(s, d).select(*ON), KEY, AXES, DIM), img2d(s, d).select(*ON), KEY, AXES, DIM), "vx", "vy"),
    f"WITH {_FLOW}, {squared('SELECT image_id, x, y, x - vx / 64 AS vx, y - vy / 64 AS vy FROM g', 6)} {rounded('f6', 'vx', 'vy')}",
)


def _products(rounds: int) -> str:
    out = []
    for k in range(rounds):
        cols = ", ".join(f"coalesce(lead({v}) OVER {w} - {v}, {v} - lag({v}) OVER {w}) AS j{b}{a}" for a, w in (("x", "wx"), ("y", "wy")) for b, v in (("x", "vx"), ("y", "vy")))
        out.append(f"j{k} AS (SELECT image_id, x, y, {cols} FROM f{k} WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))")
        made = ", ".join(f"n.j{b}x * o.jx{a} + n.j{b}y * o.jy{a} AS j{b}{a}" for b in "xy" for a in "xy")
        out.append(f"m{k} AS MATERIALIZED (SELECT * FROM j0)" if k == 0 else f"m{k} AS MATERIALIZED (SELECT image_id, x, y, {made} FROM j{k} n JOIN m{k - 1} o USING (image_id, x, y))")
    return ", ".join(out)


q(
    "t_flow_jacobian",
    lambda s, d: _out(transform.flow_jacobian(flow(img2d(s, d)), KEY, AXES, DIM), "jxx", "jxy", "jyx", "jyy", "det"),
    f"WITH {SQL_2D}, {squared(_FORWARD, 5)}, {_products(6)}, o AS (SELECT *, jxx * jyy - jxy * jyx AS det FROM m5) {rounded('o', 'jxx', 'jxy', 'jyx', 'jyy', 'det')}",
)


def _next_nodes(s, d):
    return nodes(img2d(s, d).withColumn("image_id", F.col("image_id") - 1))


_AT = lambda v: f"({v} / 2.0::DOUBLE + 1)"
q(
    "t_compose_grids",
    lambda s, d: _out(transform.compose_grids(nodes(img2d(s, d)), _next_nodes(s, d), KEY, AXES, 2), "vx", "vy"),
    f"WITH {NODES}, u AS (SELECT image_id - 1 AS image_id, x, y, vx, vy FROM n), p AS (SELECT *, {_AT('vx')} AS qx, {_AT('vy')} AS qy FROM u), k AS (SELECT p.image_id, p.x, p.y, "
    + ", ".join(f"sum((n.v{a} - (n.{a} - 1) * 2) * {basis('(qx - floor(qx))', 'i')} * {basis('(qy - floor(qy))', 'j')}) AS d{a}" for a in "xy")
    + " FROM p CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j) JOIN n ON n.image_id = p.image_id AND n.x = floor(qx) - 1 + i AND n.y = floor(qy) - 1 + j GROUP BY ALL), o AS (SELECT u.image_id, u.x, u.y, vx + coalesce(dx, 0) AS vx, vy + coalesce(dy, 0) AS vy FROM u LEFT JOIN k USING (image_id, x, y)) " + rounded("o", "vx", "vy"),
)
q("e_update_velocity", lambda s, d: _out(estimate.update_velocity(nodes(img2d(s, d)), field(img2d(s, d)), ON, ["vx", "vy"], 0.25, {"vy": False}), "vx", "vy"), f"WITH {FIELD}, n AS (SELECT image_id, x, y, value + x * 2 - 2 AS vx, value * 0.5::DOUBLE + y * 2 - 2 AS vy FROM img2d) SELECT image_id, x, y, round(n.vx + 0.25 * f.vx, 6) + 0.0 AS vx, round(n.vy, 6) + 0.0 AS vy FROM n JOIN f USING (image_id, x, y)")
for _name, _side in (("forward", 0), ("backward", 1)):
    q(
        f"e_symmetrise_{_name}",
        lambda s, d, side=_side: _out(estimate.symmetrised(flow(img2d(s, d)), flow(img2d(s, d).withColumn("image_id", F.col("image_id") - 1)), ON, ["vx", "vy"])[side], "vx", "vy"),
        f"WITH {SQL_2D} SELECT a.image_id, a.x, a.y, round((a.value - b.value) / {'-' if _side else ''}2, 6) + 0.0 AS vx, round((b.value - a.value) / {'-' if _side else ''}2, 6) + 0.0 AS vy FROM img2d a JOIN img2d b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y",
    )

_FIT = "c AS (SELECT image_id, covar_pop(x, {v}) AS cx, covar_pop(y, {v}) AS cy, var_pop(x) AS qx, var_pop(y) AS qy, avg(x) AS mx, avg(y) AS my, avg({v}) AS mv FROM n GROUP BY 1)"
q(
    "a_demean_velocities",
    lambda s, d: _out(regularise.demeaned_velocities(flow(img2d(s, d)), KEY, AXES), "vx", "vy"),
    # nodes of a whole grid are uncorrelated in x and y
    f"WITH {SQL_2D}, n AS (SELECT image_id, x, y, value FROM img2d), {_FIT.format(v='value')}, r AS (SELECT n.image_id, x, y, value - mv - cx / qx * (x - mx) - cy / qy * (y - my) AS v FROM n JOIN c USING (image_id)), o AS (SELECT *, v - avg(v) OVER (PARTITION BY x, y) AS vx, -(v - avg(v) OVER (PARTITION BY x, y)) AS vy FROM r) {rounded('o', 'vx', 'vy')}",
)
q(
    "w_average_deformed",
    lambda s, d: register.average_deformed(img2d(s, d), img2d(s, d).select(*ON, (F.col("x") + (F.col("image_id") % 2) * 0.5).alias("vx"), F.col("y").cast("double").alias("vy")), AXES).select("x", "y", r6("value").alias("value")),
    f"WITH {SQL_2D}, m AS (SELECT a.x, a.y, CASE WHEN a.image_id % 2 = 0 THEN CASE WHEN a.x < 7 AND a.y < 7 THEN a.value END WHEN a.x < 7 AND a.y < 7 THEN (a.value + b.value) / 2 END AS v FROM img2d a LEFT JOIN img2d b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1) SELECT x, y, round(coalesce(avg(v), CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM m GROUP BY ALL",
)
# --- folds and penalties


def folded(a):
    """Control grids whose values are large enough for some to fold."""
    return a.select(*ON, (F.col("value") * 4 + F.col("x") * 2 - 2).alias("vx"), (F.col("value") * 3 + F.col("y") * 2 - 2).alias("vy"))


_FOLDED = f"{SQL_2D}, n AS (SELECT image_id, x, y, value * 4 + x * 2 - 2 AS vx, value * 3 + y * 2 - 2 AS vy FROM img2d)"
_NODE_J = f"k AS ({_inner(['x', 'y'])}), j AS (SELECT image_id, x, y, vx_x / 2 AS jxx, vx_y / 2 AS jxy, vy_x / 2 AS jyx, vy_y / 2 AS jyy, vx_x / 2 * vy_y / 2 - vx_y / 2 * vy_x / 2 AS det FROM k)"
_UP = {"vx": f"(jyy * {_WEIGHTS['x']} - jyx * {_WEIGHTS['y']})", "vy": f"(jxx * {_WEIGHTS['y']} - jxy * {_WEIGHTS['x']})"}
q("s_grid_penalty", lambda s, d: _out(penalty.grid_penalty(nodes(img2d(s, d)), KEY, AXES, 2), "penalty", keys=KEY), f"WITH {NODES}, {_NODE_J} SELECT image_id, round(CASE WHEN min(det) < 0 THEN CAST('nan' AS DOUBLE) ELSE avg(pow(ln(CASE WHEN det > 0 THEN det END), 2)) END, 6) + 0.0 AS penalty FROM j GROUP BY 1")
q(
    "s_grid_penalty_gradient",
    lambda s, d: _out(penalty.penalty_gradient(nodes(img2d(s, d)), KEY, AXES, 2), "vx", "vy"),
    f"WITH {NODES}, {_NODE_J}, p AS (SELECT *, ln(det) / det AS c FROM j WHERE det > 0) " + _back("p", {v: f"c * {e} * 2" for v, e in _UP.items()}),
)
q(
    "t_correct_folding",
    lambda s, d: _out(penalty.correct_folding(folded(img2d(s, d)), KEY, AXES, 2), "vx", "vy"),
    f"WITH {_FOLDED}, {_NODE_J}, g AS (SELECT image_id, CAST(x + i AS INT) AS x, CAST(y + j.n AS INT) AS y, " + ", ".join(f"sum({e.replace('j / 2.0', 'j.n / 2.0').replace('CASE j WHEN', 'CASE j.n WHEN')}) AS g{v}" for v, e in _UP.items()) + f" FROM j q CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) j(n) WHERE det <= 0 GROUP BY ALL), o AS (SELECT n.image_id, n.x, n.y, " + ", ".join(f"{v} + coalesce(CASE WHEN gvx * gvx + gvy * gvy > 0 THEN g{v} / (5 * sqrt(gvx * gvx + gvy * gvy)) END, 0) AS {v}" for v in ("vx", "vy")) + " FROM n LEFT JOIN g USING (image_id, x, y)) " + rounded("o", "vx", "vy"),
)


def _small_grids(s, d):
    """Slices of four by four nodes."""
    return img3d(s, d).select("image_id", "z", "x", "y", (F.col("value") + F.col("x") * 2 - 2).alias("vx"), (F.col("value") * 0.5 + F.col("y") * 2 - 2).alias("vy"))


_INNER4 = _inner(["xx", "yy", "xy"]).replace("n.image_id, n.x", "n.image_id, n.z, n.x").replace("m.image_id = n.image_id", "m.image_id = n.image_id AND m.z = n.z").replace("BETWEEN 1 AND 6", "BETWEEN 1 AND 2")
q(
    "e_finite_differences",
    lambda s, d: penalty.array_differences(_small_grids(s, d), ["image_id", "z"], AXES, transform.bending_of_arrays, 0.5).select("image_id", "z", "x", "y", r6("vx").alias("vx"), r6("vy").alias("vy")),
    f"WITH {SQL_3D}, n AS (SELECT image_id, z, x, y, value + x * 2 - 2 AS vx, value * 0.5::DOUBLE + y * 2 - 2 AS vy FROM img3d), k AS ({_INNER4}) "
    + _back("k", {v: " + ".join(f"{4 if c == 'xy' else 2} * {v}_{c} * {_WEIGHTS[c]}" for c in ("xx", "yy", "xy")) for v in ("vx", "vy")}).replace("/ 128", "/ 32").replace("SELECT image_id,", "SELECT image_id, z,"),
)

# --- conversions
_grid = lambda s, d: convert.Transformation("grid", nodes(img2d(s, d)), 2.0)
_affine = convert.Transformation("affine", M)
q(
    "t_displacement_of_grid",
    lambda s, d: _out(convert.displacement(_grid(s, d), _voxels(s, d), KEY, AXES, {"x": 9, "y": 9}), "vx", "vy"),
    f"WITH {NODES}, {VOX}, g AS ({_spline()}), o AS (SELECT image_id, x, y, vx - x AS vx, vy - y AS vy FROM g) {rounded('o', 'vx', 'vy')}",
)
q(
    "t_affine_after_grid",
    lambda s, d: _out(convert.composed(_affine, _grid(s, d), _voxels(s, d), KEY, AXES, {"x": 9, "y": 9}).data, "vx", "vy"),
    f"WITH {NODES}, {VOX}, g AS ({_spline()}), o AS (SELECT image_id, x, y, 2.0 * vx + 0.5 * vy - 3.0 AS vx, -0.25 * vx + 1.5 * vy + 4.0 AS vy FROM g) {rounded('o', 'vx', 'vy')}",
)
q(
    "t_invert_affine",
    lambda s, d: _out(convert.deformation(convert.inverted(_affine, img2d(s, d), KEY, AXES, DIM), img2d(s, d).select(*ON), KEY, AXES, DIM), "vx", "vy"),
    f"WITH {SQL_2D}, o AS (SELECT image_id, x, y, (1.5 * (x + 3) - 0.5 * (y - 4)) / 3.125::DOUBLE AS vx, (0.25 * (x + 3) + 2 * (y - 4)) / 3.125::DOUBLE AS vy FROM img2d) {rounded('o', 'vx', 'vy')}",
)
q(
    "t_landmarks_affine",
    lambda s, d: _out(convert.landmarks(_affine, img2d(s, d).withColumns({"px": F.col("x") + F.col("value"), "py": F.col("y") - F.col("value")}), None, KEY, AXES, DIM, AXES), "vx", "vy"),
    f"WITH {SQL_2D}, o AS (SELECT image_id, x, y, 2.0 * (x + value) + 0.5 * (y - value) - 3.0 AS vx, -0.25 * (x + value) + 1.5 * (y - value) + 4.0 AS vy FROM img2d) {rounded('o', 'vx', 'vy')}",
)


# --- inverse fields, step by step
def _inverse_sql(rounds: int) -> str:
    steps = ["v0 AS MATERIALIZED (SELECT image_id, x, y, x::DOUBLE AS vx, y::DOUBLE AS vy FROM img2d)"]
    for k in range(rounds):
        p = f"SELECT image_id, x, y, vx AS qx, vy AS qy, least(greatest(vx, 0), 7) AS cx, least(greatest(vy, 0), 7) AS cy FROM v{k}"
        steps.append(f"v{k + 1} AS MATERIALIZED (WITH l AS (SELECT *, least(floor(cx), 6) AS lx, least(floor(cy), 6) AS ly FROM ({p})) SELECT l.image_id, l.x, l.y, max(qx) - (sum(f.vx * {_W}) + max(qx - cx) - max(l.x)) AS vx, max(qy) - (sum(f.vy * {_W}) + max(qy - cy) - max(l.y)) AS vy FROM l CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) JOIN f ON f.image_id = l.image_id AND f.x = lx + i AND f.y = ly + j GROUP BY ALL)")
    return ", ".join(steps)


q("t_invert_field", lambda s, d: _out(transform.invert_field(field(img2d(s, d)), KEY, AXES, DIM, 5), "vx", "vy"), f"WITH {FIELD}, {_inverse_sql(5)} {rounded('v5', 'vx', 'vy')}")
