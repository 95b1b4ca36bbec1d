"""Queries of estimation, optimisation and registration. Those that iterate on the driver have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import estimate as e
from ..operators import matrix, measures, register, transform
from ..operators import stencil as c
from .measuring import BINNED, pairs
from .points import ON, PAIRS
from .transforms import FIELD, _out, field
from .views import SQL_4D, img2d, img4d, table

QUERIES = []
KEY, AXES = ["image_id"], ["x", "y"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def point_pairs(s, d):
    """Line items as points: quantity and price against what an affine with a little noise makes of them."""
    li = table(s, d, "lineitem").select(F.col("l_quantity").alias("rx"), (F.col("l_extendedprice") / 1000).alias("ry"), "l_discount", "l_tax")
    return li.select("rx", "ry", (F.col("rx") * 1.1 + F.col("ry") * 0.2 - 3 + F.col("l_discount") - F.col("l_tax")).alias("wx"), (F.col("ry") * 0.9 - F.col("rx") * 0.1 + 5 + F.col("l_tax")).alias("wy"))


POINT_PAIRS = "p AS (SELECT l_quantity AS rx, l_extendedprice / 1000 AS ry, l_quantity * 1.1::DOUBLE + l_extendedprice / 1000 * 0.2::DOUBLE - 3 + l_discount - l_tax AS wx, l_extendedprice / 1000 * 0.9::DOUBLE - l_quantity * 0.1::DOUBLE + 5 + l_tax AS wy FROM lineitem)"
_SUMS = {"sr0": "rx", "sr1": "ry", "sw0": "wx", "sw1": "wy", "rr00": "rx * rx", "rr01": "rx * ry", "rr11": "ry * ry", "rw00": "rx * wx", "rw01": "rx * wy", "rw10": "ry * wx", "rw11": "ry * wy"}
q(
    "e_affine_normal_eq",
    lambda s, d: e.moments(point_pairs(s, d), 2).select("n", *[F.round(F.col(k) / F.col("n"), 4).alias(k) for k in _SUMS]),
    f"WITH {POINT_PAIRS} SELECT count(*) AS n, " + ", ".join(f"round(avg({v}), 4) AS {k}" for k, v in _SUMS.items()) + " FROM p",
)


def matrix_rows(s, m):
    return s.createDataFrame([(i, j, round(float(m[i, j]), 6) + 0.0) for i in range(len(m)) for j in range(len(m))], "i int, j int, v double")


q("e_lts_affine", lambda s, d: matrix_rows(s, e.trimmed_fit(point_pairs(s, d), 2, 50)))
q("e_lts_rigid", lambda s, d: matrix_rows(s, e.trimmed_fit(point_pairs(s, d), 2, 50, rigid=True)))


def with_slopes(s, d):
    g = c.gradient(img2d(s, d).withColumn("image_id", F.col("image_id") - 1), KEY, AXES).select(*ON, F.col("gx").alias("sx"), F.col("gy").alias("sy"))
    return pairs(s, d).join(g, ON)


SLOPES = f"{PAIRS}, g AS (SELECT image_id - 1 AS image_id, x, y, (coalesce(lead(value) OVER a, 0) - coalesce(lag(value) OVER a, 0)) / 2 AS sx, (coalesce(lead(value) OVER b, 0) - coalesce(lag(value) OVER b, 0)) / 2 AS sy FROM img2d WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y))"
q("e_ssd_gradient", lambda s, d: _out(e.ssd_gradient(with_slopes(s, d), KEY, AXES), "gx", "gy"), f"WITH {SLOPES} SELECT image_id, x, y, round(-2 * (value - w) / 64 * sx, 6) + 0.0 AS gx, round(-2 * (value - w) / 64 * sy, 6) + 0.0 AS gy FROM pairs JOIN g USING (image_id, x, y)")
q(
    "e_kld_gradient",
    lambda s, d: _out(e.kld_gradient(with_slopes(s, d).withColumns({"value": F.abs("value") + 0.1, "w": F.abs("w") + 0.1}), KEY, AXES), "gx", "gy"),
    f"WITH {SLOPES} SELECT image_id, x, y, round((abs(value) + 0.1 + 1e-16) / (abs(w) + 0.1 + 1e-16) / 64 * sx, 6) + 0.0 AS gx, round((abs(value) + 0.1 + 1e-16) / (abs(w) + 0.1 + 1e-16) / 64 * sy, 6) + 0.0 AS gy FROM pairs JOIN g USING (image_id, x, y)",
)


def _nmi_gradient(s, d):
    p = measures.in_bins(with_slopes(s, d), KEY, 20)
    return e.nmi_gradient(p, measures.joint_histogram(p, KEY, 20, exact=True), KEY, AXES, AXES)


_B = lambda v: f"(CASE WHEN abs({v}) < 1 THEN 2.0::DOUBLE / 3 + (abs({v}) / 2 - 1) * ({v}) * ({v}) WHEN abs({v}) < 2 THEN pow(2 - abs({v}), 3) / 6 ELSE 0 END)"
_BD = lambda v: f"(CASE WHEN abs({v}) < 1 THEN sign({v}) * (1.5 * abs({v}) - 2) * abs({v}) WHEN abs({v}) < 2 THEN -sign({v}) * 0.5 * pow(2 - abs({v}), 2) ELSE 0 END)"
q(
    "e_nmi_gradient",
    lambda s, d: _out(_nmi_gradient(s, d), "gx", "gy"),
    f"WITH {SLOPES}, {BINNED.removeprefix(PAIRS + ', ').replace('SELECT image_id, (value - rl)', 'SELECT image_id, x, y, (value - rl)')}, hist AS (SELECT image_id, CAST(floor(value) AS INT) + i AS r, CAST(floor(w) AS INT) + j AS f, sum({_B('(value - floor(value) - i)')} * {_B('(w - floor(w) - j)')}) AS h FROM b, range(-1, 3) a(i), range(-1, 3) c(j) GROUP BY ALL), p AS (SELECT *, h / sum(h) OVER (PARTITION BY image_id) AS p, sum(h) OVER (PARTITION BY image_id) AS mass FROM hist WHERE h > 0), l AS (SELECT *, ln(p) AS lrf, ln(sum(p) OVER (PARTITION BY image_id, r)) AS lr, ln(sum(p) OVER (PARTITION BY image_id, f)) AS lf FROM p), e AS (SELECT image_id, -sum(p * lrf) AS hrf, (-sum(p * lr) - sum(p * lf)) / -sum(p * lrf) AS nmi, max(mass) AS mass FROM l GROUP BY 1), t AS (SELECT b.image_id, b.x, b.y, sum(k * lrf) AS j, sum(k * lr) + sum(k * lf) AS m FROM (SELECT *, CAST(floor(value) AS INT) + i AS r, CAST(floor(w) AS INT) + j AS f, {_B('(value - floor(value) - i)')} * {_BD('(w - floor(w) - j)')} AS k FROM b, range(-1, 3) a(i), range(-1, 3) c(j)) b JOIN l USING (image_id, r, f) GROUP BY ALL) SELECT t.image_id, t.x, t.y, round((m - nmi * j) / (hrf * mass) * sx, 6) + 0.0 AS gx, round((m - nmi * j) / (hrf * mass) * sy, 6) + 0.0 AS gy FROM t JOIN e USING (image_id) JOIN g USING (image_id, x, y)",
)
q("e_normalise_gradient", lambda s, d: _out(e.normalise_gradient(field(img2d(s, d)), KEY, ["vx", "vy"]), "vx", "vy"), f"WITH {FIELD}, m AS (SELECT image_id, max(sqrt(vx * vx + vy * vy)) AS m FROM f GROUP BY 1) SELECT image_id, x, y, round(vx / m, 6) + 0.0 AS vx, round(vy / m, 6) + 0.0 AS vy FROM f JOIN m USING (image_id)")
q("e_step", lambda s, d: _out(e.step(field(img2d(s, d)), field(img2d(s, d)).where("x > 2"), ON, ["vx", "vy"], -0.5), "vx", "vy"), f"WITH {FIELD} SELECT image_id, x, y, round(CASE WHEN x > 2 THEN vx * 0.5 ELSE vx END, 6) + 0.0 AS vx, round(CASE WHEN x > 2 THEN vy * 0.5 ELSE vy END, 6) + 0.0 AS vy FROM f")
q(
    "e_conjugate",
    lambda s, d: _out(e.conjugate(field(img2d(s, d)), field(img2d(s, d)).select(*ON, (F.col("vx") * 0.9).alias("pvx"), (F.col("vy") * 0.8 + 0.1).alias("pvy"), (F.col("vx") - 1).alias("hvx"), (F.col("vy") + 1).alias("hvy")), KEY, ON, ["vx", "vy"]), "hvx", "hvy"),
    f"WITH {FIELD}, b AS (SELECT *, vx * 0.9::DOUBLE AS px, vy * 0.8::DOUBLE + 0.1::DOUBLE AS py FROM f), k AS (SELECT image_id, greatest(sum((vx - px) * vx + (vy - py) * vy) / sum(px * px + py * py), 0) AS g FROM b GROUP BY 1) SELECT image_id, x, y, round(vx + g * (vx - 1), 6) + 0.0 AS hvx, round(vy + g * (vy + 1), 6) + 0.0 AS hvy FROM b JOIN k USING (image_id)",
)


def _pca(s, d):
    a = img4d(s, d)
    cov = measures.time_covariance(a, ["series_id"], AXES)
    return e.project_over_time(a, ["series_id"], AXES, cov, 4).select("series_id", "t", "x", "y", r6("value").alias("value"))


q("e_pca_all_parts", _pca, f"WITH {SQL_4D} SELECT series_id, t, x, y, round(value, 6) + 0.0 AS value FROM img4d")
q("e_pca_two_parts", lambda s, d: e.project_over_time(img4d(s, d), ["series_id"], AXES, measures.time_covariance(img4d(s, d), ["series_id"], AXES), 2).select("series_id", "t", "x", "y", r6("value").alias("value")))
def _moved(s, d):
    """A matrix for each image: those of odd numbers move by a quarter of a voxel."""
    one = {k: F.lit(float(k in (0, 5, 10))) for k in range(12)} | {3: (F.abs(F.col("image_id")) % 2) * 0.25}
    return table(s, d, "embeddings").select(F.col("vec_id").alias("image_id")).distinct().select("image_id", *[one[k].alias(f"m{k}") for k in range(12)])


_AVERAGED = f"WITH {PAIRS.split(', pairs AS')[0]}, m AS (SELECT a.x, a.y, CASE WHEN a.x = 7 OR a.y = 7 THEN NULL WHEN a.image_id % 2 = 0 THEN a.value ELSE a.value * 0.75 + b.value * 0.25 END AS v FROM img2d a LEFT JOIN img2d b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1) SELECT x, y, round(coalesce(avg(v), CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM m GROUP BY ALL"
for _name in ("w_average_images", "w_average_all_images"):
    q(_name, lambda s, d: register.average_images(img2d(s, d), _moved(s, d), AXES).select("x", "y", r6("value").alias("value")), _AVERAGED)


def blob(s, n=32, dx=0.0, dy=0.0):
    """A picture with structure at several scales, moved by (dx, dy)."""
    x, y = F.col("x") - dx, F.col("y") - dy
    v = F.exp(-((x - 13) ** 2 + (y - 17) ** 2) / 60.0) * 100 + 20 * F.sin(x / 2.3) * F.cos(y / 1.9) + 10 * F.sin(x * y / 37.0)
    return transform.grid(s, n, n).select("x", "y", v.alias("value"))


def mosaic(s, d):
    """All images side by side as one picture."""
    a = img2d(s, d)
    wide = int(a.select("image_id").distinct().count() ** 0.5) + 1
    return a.select(((F.col("image_id") % wide) * 8 + F.col("x")).cast("int").alias("x"), (F.floor(F.col("image_id") / wide) * 8 + F.col("y")).cast("int").alias("y"), "value"), wide * 8


def _registered(s, d):
    """The picture of all images against itself, moved by two voxels along x and one back along y."""
    picture, side = mosaic(s, d)
    moved = picture.withColumns({"x": F.col("x") + 2, "y": F.col("y") - 1})
    return matrix_rows(s, register.affine_registration(picture, moved, AXES, {"x": side, "y": side}, levels=1, rounds=1))


q("w_affine_registration", _registered, "SELECT CAST(k // 4 AS INT) AS i, CAST(k % 4 AS INT) AS j, CASE k WHEN 3 THEN 2 WHEN 7 THEN -1 ELSE CASE WHEN k // 4 = k % 4 THEN 1 ELSE 0 END END::DOUBLE AS v FROM range(16) t(k)")
