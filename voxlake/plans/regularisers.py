"""Queries of regularisers, measure slopes of several channels, tensors and demeaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regularise as g
from .measuring import pairs
from .points import ON, PAIRS
from .transforms import AXES, FIELD, KEY, NODES, _out, field, nodes
from .views import img2d

QUERIES = []


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


_AROUND = "CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j)"
_V = lambda i: f"(CASE {i} WHEN 0 THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 6 END)"
_WEIGHTS = {"xx": f"(CASE i WHEN 0 THEN -2 ELSE 1 END * {_V('j')})", "yy": f"(CASE j WHEN 0 THEN -2 ELSE 1 END * {_V('i')})", "xy": "(i / 2.0::DOUBLE * j / 2.0::DOUBLE)", "x": f"(i / 2.0::DOUBLE * {_V('j')})", "y": f"(j / 2.0::DOUBLE * {_V('i')})"}


def _inner(kinds):
    cols = ", ".join(f"sum(m.{v} * {_WEIGHTS[k]}) AS {v}_{k}" for v in ("vx", "vy") for k in kinds)
    return f"SELECT n.image_id, n.x, n.y, {cols} FROM n {_AROUND} JOIN n m ON m.image_id = n.image_id AND m.x = n.x + i AND m.y = n.y + j WHERE n.x BETWEEN 1 AND 6 AND n.y BETWEEN 1 AND 6 GROUP BY ALL"


def _back(source, sums):
    cols = ", ".join(f"round(sum({e}) / 128, 6) + 0.0 AS {v}" for v, e in sums.items())
    return f"SELECT image_id, CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, {cols} FROM {source} {_AROUND} GROUP BY ALL"


q(
    "s_bending_gradient",
    lambda s, d: _out(g.bending_gradient(nodes(img2d(s, d)), KEY, AXES), "vx", "vy"),
    f"WITH {NODES}, k AS ({_inner(['xx', 'yy', 'xy'])}) " + _back("k", {v: " + ".join(f"{4 if c == 'xy' else 2} * {v}_{c} * {_WEIGHTS[c]}" for c in ("xx", "yy", "xy")) for v in ("vx", "vy")}),
)
_STRAIN = f"{NODES}, k AS ({_inner(['x', 'y'])}), j AS (SELECT *, atan2((vy_x - vx_y) / 2, (vx_x + vy_y) / 2) AS angle FROM k), e AS (SELECT image_id, x, y, vx_x / 2 - cos(angle) AS exx, vx_y / 2 + sin(angle) AS exy, vy_x / 2 - sin(angle) AS eyx, vy_y / 2 - cos(angle) AS eyy FROM j)"
q(
    "s_linear_energy",
    lambda s, d: _out(g.linear_energy(nodes(img2d(s, d)), KEY, AXES, 2), "energy", keys=KEY),
    f"WITH {_STRAIN} SELECT image_id, round(sum(exx * exx + exy * exy + eyx * eyx + eyy * eyy) / 128, 6) + 0.0 AS energy FROM e GROUP BY 1",
)
q(
    "s_linear_gradient",
    lambda s, d: _out(g.linear_gradient(nodes(img2d(s, d)), KEY, AXES, 2), "vx", "vy"),
    f"WITH {_STRAIN} " + _back("e", {"vx": f"exx * {_WEIGHTS['x']} + exy * {_WEIGHTS['y']}", "vy": f"eyx * {_WEIGHTS['x']} + eyy * {_WEIGHTS['y']}"}),
)


def _tensor_slopes(s, d):
    """Columns x = 0..5 of each line as tensor channels, their slope along y by the channel's number and the line's."""
    rows = pairs(s, d).groupBy("image_id", "y").agg(*[F.max(F.when(F.col("x") == k, F.col(c))).alias(f"{n}{k}") for k in range(6) for c, n in (("value", "r"), ("w", "w"))])
    return rows.withColumns({f"s{k}y": F.col("y") * 0.5 + float(k) for k in range(6)})


q(
    "e_dti_gradient",
    lambda s, d: _out(g.dti_gradient(_tensor_slopes(s, d), KEY, ["y"], ["y"]), "gy", keys=["image_id", "y"]),
    f"WITH {PAIRS}, t AS (SELECT image_id, y, " + ", ".join(f"max(value - w) FILTER (WHERE x = {k}) AS d{k}" for k in range(6)) + " FROM pairs GROUP BY ALL) SELECT image_id, y, round(-("
    + " + ".join((f"(4.0::DOUBLE / 3 * d{k} - 2.0::DOUBLE / 3 * ({' + '.join(f'd{m}' for m in (0, 2, 5) if m != k)}))" if k in (0, 2, 5) else f"4 * d{k}") + f" * (y * 0.5::DOUBLE + {k})" for k in range(6))
    + ") / count(*) OVER (PARTITION BY image_id), 6) + 0.0 AS gy FROM t",
)
q(
    "a_demean_fields",
    lambda s, d: _out(g.demeaned_fields(field(img2d(s, d)), AXES), "vx", "vy"),
    f"WITH {FIELD} SELECT image_id, x, y, round(vx - avg(vx - x) OVER (PARTITION BY x, y), 6) + 0.0 AS vx, round(vy - avg(vy - y) OVER (PARTITION BY x, y), 6) + 0.0 AS vy FROM f",
)
_LINEAR = " + ".join(f"coalesce({n}.{{v}}, CAST('nan' AS DOUBLE)) * {wx} * {wy}" for n, wx, wy in (("a", "(1 - f)", "(1 - g)"), ("b", "f", "(1 - g)"), ("c", "(1 - f)", "g"), ("e", "f", "g")))
_LINEAR_SQL = (
    f"WITH {NODES}, p AS (SELECT image_id, x, y, x // 2 + 1 AS i, y // 2 + 1 AS j, x % 2 / 2.0::DOUBLE AS f, y % 2 / 2.0::DOUBLE AS g FROM img2d) SELECT p.image_id, p.x, p.y, "
    + ", ".join(f"round({_LINEAR.format(v=v)}, 6) + 0.0 AS {v}" for v in ("vx", "vy"))
    + " FROM p " + " ".join(f"LEFT JOIN n {n} ON {n}.image_id = p.image_id AND {n}.x = i + {dx} AND {n}.y = j + {dy}" for n, dx, dy in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("e", 1, 1)))
)
for _name in ("t_linear_spline_field", "t_linear_spline_all"):
    q(_name, lambda s, d: _out(g.linear_spline_field(img2d(s, d), nodes(img2d(s, d)), KEY, AXES, 2), "vx", "vy"), _LINEAR_SQL)
