"""Queries of measures by name, masks, weights, smoothed gradients and resolution changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import estimate, regularise, resample, stencil, transform, voxel
from ..operators import measures as m
from ..sources import images
from .estimates import SLOPES, with_slopes
from .measuring import _m, pairs
from .points import HOLES, M, ON, PAIRS, _holes, _next
from .resampling import sql as resample_sql
from .resampling import weights
from .stencils import _MIND, _SSC, _descriptor_sql, conv_sql, kernel_values
from .transforms import AXES, FIELD, KEY, _out, field
from .views import SQL_2D, SQL_3D, SQL_4D, img2d, img3d, img4d, table

QUERIES = []


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


# --- measures


def _descriptor_measure_sql(moves) -> str:
    n = len(moves)
    return f"WITH d AS ({_descriptor_sql(moves).replace('round(', '(').replace(', 6) + 0.0 AS d', ') AS d')}) SELECT a.image_id, round(-avg(" + " + ".join(f"pow(a.d{i} - b.d{i}, 2)" for i in range(n)) + "), 6) + 0.0 AS measure FROM d a JOIN d b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y GROUP BY 1"


q("a_mind_value", lambda s, d: _m(m.measure("mind", pairs(s, d), KEY, AXES)), _descriptor_measure_sql(_MIND))
q("a_mindssc_value", lambda s, d: _m(m.measure("mindssc", pairs(s, d), KEY, AXES)), _descriptor_measure_sql(_SSC))
_turned = lambda p: p.select(*ON, F.col("w").alias("value"), F.col("value").alias("w"))
q(
    "a_both_ways",
    lambda s, d: _m(m.both_ways(m.measure("kld", pairs(s, d).withColumns({"value": F.abs("value"), "w": F.abs("w")}), KEY, AXES), m.measure("kld", _turned(pairs(s, d).withColumns({"value": F.abs("value"), "w": F.abs("w")})), KEY, AXES), KEY)),
    f"WITH {PAIRS}, k AS (SELECT image_id, abs(value) + 1e-16 AS r, abs(w) + 1e-16 AS f FROM pairs) SELECT image_id, round(-avg(r * ln(r / f)) - avg(f * ln(f / r)), 6) + 0.0 AS measure FROM k GROUP BY 1",
)
q(
    "a_measures_by_name",
    lambda s, d: m.weighted_sum([(m.measure("ssd", pairs(s, d), KEY, AXES), 2.0), (m.measure("ncc", pairs(s, d), KEY, AXES), 1.0)], KEY).select("image_id", r6("measure").alias("measure")),
    f"WITH {PAIRS} SELECT image_id, round(-2 * avg((value - w) * (value - w)) + corr(value, w), 6) + 0.0 AS measure FROM pairs GROUP BY 1",
)
q(
    "f_active_times",
    lambda s, d: m.active_times(img4d(s, d), img4d(s, d).groupBy("series_id", "t").agg(F.avg("value").alias("weight")), ["series_id"]).select("series_id", "t", "x", "y", r6("value").alias("value")),
    f"WITH {SQL_4D} SELECT series_id, t, x, y, round(value, 6) + 0.0 AS value FROM img4d QUALIFY avg(value) OVER (PARTITION BY series_id, t) > 0",
)
q(
    "f_thresholds",
    lambda s, d: voxel.within_thresholds(img2d(s, d).select(*ON), _holes(img2d(s, d)), ON, -0.1, 0.05),
    f"WITH {HOLES} SELECT image_id, x, y FROM holes WHERE NOT isnan(value) AND value BETWEEN -0.1 AND 0.05",
)
_active = lambda a: voxel.mask_of(voxel.binarise_at(a, 0.0))
q(
    "a_mask_centre_shift",
    lambda s, d: m.mask_shift(_active(img2d(s, d)), _active(_next(img2d(s, d))), KEY, M).select("image_id", *[(r6(f"t{a}") + 0.0).alias(f"t{a}") for a in "xyz"]),
    f"WITH {SQL_2D}, c AS (SELECT image_id, avg(x) AS a, avg(y) AS b FROM img2d WHERE value >= 0 GROUP BY 1) SELECT a.image_id, round(2 * (b.a - a.a) + 0.5 * (b.b - a.b), 6) + 0.0 AS tx, round(-0.25 * (b.a - a.a) + 1.5 * (b.b - a.b), 6) + 0.0 AS ty, 0.0::DOUBLE AS tz FROM c a JOIN c b ON b.image_id = a.image_id + 1",
)
q(
    "a_painted_blocks",
    lambda s, d: _out(m.painted_blocks(_holes(img2d(s, d)), KEY, AXES), "value"),
    f"WITH {HOLES}, b AS (SELECT image_id, x // 4 AS bx, y // 4 AS by, CASE WHEN count(*) > 8 AND var_pop(value) > 0 THEN var_pop(value) ELSE -1 END AS v FROM holes WHERE NOT isnan(value) GROUP BY ALL) SELECT h.image_id, h.x, h.y, round(v, 6) + 0.0 AS value FROM holes h JOIN b ON b.image_id = h.image_id AND b.bx = h.x // 4 AND b.by = h.y // 4",
)
# --- convolved fields and slopes of the local correlation
_CF = f"{FIELD}, one AS (SELECT image_id, x, y, {{v}} AS value FROM f)"
for _name, _kind, _s in (("c_smooth_gradient", "gauss", 1.2), ("c_node_convolution", "cubic", 2.0)):
    _parts = {v: conv_sql(_kind, _s, base=_CF.format(v=v), source="one") for v in ("vx", "vy")}
    q(
        _name,
        lambda s, d, kind=_kind, sig=_s: _out(stencil.convolve_components(field(img2d(s, d)), KEY, AXES, dict.fromkeys(AXES, -sig), ["vx", "vy"], kind), "vx", "vy"),
        f"SELECT a.image_id, a.x, a.y, a.value AS vx, b.value AS vy FROM ({_parts['vx']}) a JOIN ({_parts['vy']}) b USING (image_id, x, y)",
    )


def _smoothed(source: str, names: tuple[str, ...], to: str, keep: str = "") -> str:
    step = lambda src, axis: "SELECT a.image_id, a.x, a.y, " + ", ".join(f"sum(k.k * b.{n}) AS {n}" for n in (*names, "o")) + f" FROM {src} a CROSS JOIN {kernel_values('gauss', 2.0)} k(i, k) JOIN {src} b ON a.image_id = b.image_id AND b.x = a.x + {'k.i' if axis == 'x' else '0'} AND b.y = a.y + {'k.i' if axis == 'y' else '0'} GROUP BY a.image_id, a.x, a.y"
    return f"{to}_a AS ({step(source, 'x')}), {to}_b AS ({step(f'{to}_a', 'y')}), {to} AS (SELECT image_id, x, y, " + ", ".join(f"{n} / o AS {n}" for n in names) + f" FROM {to}_b)"


q(
    "e_lncc_gradient",
    lambda s, d: _out(estimate.lncc_gradient(with_slopes(s, d), KEY, AXES, -2.0), "gx", "gy"),
    f"WITH {SLOPES}, s0 AS (SELECT image_id, x, y, value AS r, w AS f, value * value AS rr, w * w AS ff, value * w AS rf, 1.0::DOUBLE AS o FROM pairs), {_smoothed('s0', ('r', 'f', 'rr', 'ff', 'rf'), 'l')}, d AS (SELECT *, sqrt(greatest(rr - r * r, 0)) AS sr, sqrt(greatest(ff - f * f, 0)) AS sf, rf - r * f AS c FROM l), t AS (SELECT image_id, x, y, 1.0::DOUBLE AS o, CASE WHEN c < 0 THEN -1 ELSE 1 END / (sr * sf) AS t1, CASE WHEN c < 0 THEN -1 ELSE 1 END * c / (sr * sf * sf * sf) AS t2, CASE WHEN c < 0 THEN -1 ELSE 1 END * (c * f / (sr * sf * sf * sf) - r / (sr * sf)) AS t3 FROM d), {_smoothed('t', ('t1', 't2', 't3'), 'u')} SELECT p.image_id, p.x, p.y, "
    + ", ".join(f"round(-s{a} * (t1 * p.value - t2 * p.w + t3) / 64, 6) + 0.0 AS g{a}" for a in "xy")
    + " FROM pairs p JOIN u USING (image_id, x, y) JOIN g USING (image_id, x, y)",
)
# --- grids of other resolutions
q(
    "a_local_weight",
    lambda s, d: resample.resample(img2d(s, d).withColumn("value", F.abs("value")), transform.affine_field(img2d(s, d), [0.5, 0.0, 0.0, 0.25, 0.0, 0.5, 0.0, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], AXES).select(*ON, F.col("vx").alias("px"), F.col("vy").alias("py")), KEY, AXES, AXES).select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D}, pts AS (SELECT image_id, x, y, x * 0.5::DOUBLE + 0.25::DOUBLE AS px, y * 0.5::DOUBLE + 0.5::DOUBLE AS py FROM img2d), g AS ({resample_sql(1).replace('s.value', 'abs(s.value)')}) SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM g",
)
q(
    "r_mask_pyramid",
    lambda s, d: resample.mask_pyramid(_active(img2d(s, d)), {"x": 8, "y": 8}, 2, least=4)[0].where("active").select(*ON),
    f"WITH {SQL_2D} SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y FROM img2d WHERE x % 2 = 0 AND y % 2 = 0 AND value >= 0",
)


def _isotropic(s, d):
    _, dim, factor, shift = resample.isotropic([1.0, 2.0], [8, 8])
    targets = table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(dim[0] - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(dim[1] - 1))).alias("y"))
    return resample.change_resolution(img2d(s, d), targets, KEY, AXES, dict(zip(AXES, factor, strict=True)), dict(zip(AXES, shift, strict=True)))


q(
    "r_isotropic",
    lambda s, d: _isotropic(s, d).select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D}, pts AS (SELECT DISTINCT i.image_id, i.x, CAST(t.y AS INT) AS y, i.x + 0.0::DOUBLE AS px, t.y * 0.5::DOUBLE - 0.25::DOUBLE AS py FROM img2d i, range(16) t(y)), g AS ({resample_sql(1)}) SELECT image_id, x, y, round(value, 6) + 0.0 AS value FROM g",
)
_SIGMA = float((1.5**2 - 1.0) ** 0.5 / resample.FULL_WIDTH)
_E = f"e AS (SELECT image_id, x, y, x * 1.5::DOUBLE + 0.25::DOUBLE + a.i / 2.0::DOUBLE * {_SIGMA!r}::DOUBLE AS px, y * 1.0::DOUBLE AS py, exp(-0.125::DOUBLE * a.i * a.i) AS w FROM img2d CROSS JOIN range(-4, 5) a(i))"
q(
    "r_change_resolution_psf",
    lambda s, d: resample.change_resolution(img2d(s, d), img2d(s, d), KEY, AXES, {"x": 1.5, "y": 1.0}, {"x": 0.25, "y": 0.0}).select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D}, {_E}, t AS (SELECT e.image_id, e.x, e.y, s.value, w * {weights(1, '(px - floor(px))', 'i')} * {weights(1, '(py - floor(py))', 'j')} AS k FROM e CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) LEFT JOIN img2d s ON s.image_id = e.image_id AND s.x = floor(px) + i AND s.y = floor(py) + j) SELECT image_id, x, y, round(coalesce(sum(value * k) / nullif(sum(k) FILTER (WHERE value IS NOT NULL), 0), CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM t GROUP BY ALL",
)
q(
    "r_clamped_to_type",
    lambda s, d: resample.resample(img2d(s, d).withColumn("value", F.col("value") * 600 + 100), img2d(s, d).select(*ON, (F.col("x") + 0.5).alias("px"), F.col("y").cast("double").alias("py")), KEY, AXES, AXES, 3, limits=voxel.TYPE_RANGES["uint8"]).select(*ON, r6("value").alias("value")),
    f"WITH {SQL_2D}, pts AS (SELECT image_id, x, y, x + 0.5::DOUBLE AS px, y::DOUBLE AS py FROM img2d), g AS ({resample_sql(3).replace('coalesce(s.value, 0)', 'coalesce(s.value * 600 + 100, 0)')}) SELECT image_id, x, y, round(least(greatest(value, 0), 255), 6) + 0.0 AS value FROM g",
)
for _n, _o in (("nearest", 0), ("cubic", 3), ("sinc", 4)):
    _count, _before = {0: (2, 0), 3: (4, 1), 4: (6, 2)}[_o]
    _k = " * ".join(weights(_o, f"(p{a} - floor(p{a}))", i) for a, i in zip("xyz", "ijk", strict=True))
    q(
        f"r_{_n}_3d",
        lambda s, d, o=_o: resample.resample(img3d(s, d), img3d(s, d).withColumns({f"p{a}": F.col(a) * 0.8 + 0.3 for a in "xyz"}), KEY, ["x", "y", "z"], ["x", "y", "z"], o).select("image_id", "x", "y", "z", r6("value").alias("value")),
        f"WITH {SQL_3D}, p AS (SELECT image_id, x, y, z, x * 0.8::DOUBLE + 0.3::DOUBLE AS px, y * 0.8::DOUBLE + 0.3::DOUBLE AS py, z * 0.8::DOUBLE + 0.3::DOUBLE AS pz FROM img3d) SELECT p.image_id, p.x, p.y, p.z, round(sum(coalesce(s.value, 0) * {_k}), 6) + 0.0 AS value FROM p CROSS JOIN range({_count}) a(i) CROSS JOIN range({_count}) b(j) CROSS JOIN range({_count}) c(k) LEFT JOIN img3d s ON s.image_id = p.image_id AND s.x = floor(px) - {_before} + i AND s.y = floor(py) - {_before} + j AND s.z = floor(pz) - {_before} + k GROUP BY p.image_id, p.x, p.y, p.z",
    )
# --- components and time points
q(
    "p_field_components",
    lambda s, d: images.vector_rows(field(img2d(s, d)), KEY, AXES, ["vx", "vy"]).select("image_id", "x", "y", "u", r6("value").alias("value")),
    f"WITH {FIELD} SELECT image_id, x, y, CAST(u AS INT) AS u, round(CASE u WHEN 0 THEN vx ELSE vy END, 6) + 0.0 AS value FROM f, range(2) t(u)",
)
q(
    "p_field_from_components",
    lambda s, d: _out(images.vector_columns(img4d(s, d).where("t < 2").select(F.col("series_id").alias("image_id"), "x", "y", F.col("t").alias("u"), "value"), KEY, AXES, ["vx", "vy"]), "vx", "vy"),
    f"WITH {SQL_4D} SELECT series_id AS image_id, x, y, round(max(value) FILTER (WHERE t = 0), 6) + 0.0 AS vx, round(max(value) FILTER (WHERE t = 1), 6) + 0.0 AS vy FROM img4d WHERE t < 2 GROUP BY ALL",
)
q(
    "p_jacobian_image",
    lambda s, d: images.vector_rows(transform.field_jacobian(field(img2d(s, d)), KEY, AXES), KEY, AXES, ["jxx", "jxy", "jyx", "jyy"]).select("image_id", "x", "y", "u", r6("value").alias("value")),
    f"WITH {FIELD}, j AS (SELECT *, " + ", ".join(f"coalesce(lead({v}) OVER {w} - {v}, {v} - lag({v}) OVER {w}) AS j{b}{a}" for a, w in (("x", "wx"), ("y", "wy")) for b, v in (("x", "vx"), ("y", "vy"))) + " FROM f WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, x, y, CAST(u AS INT) AS u, round(CASE u WHEN 0 THEN jxx WHEN 1 THEN jxy WHEN 2 THEN jyx ELSE jyy END, 6) + 0.0 AS value FROM j, range(4) t(u)",
)
q(
    "p_stack_volumes",
    lambda s, d: images.stack_times([img2d(s, d).where(F.col("image_id") % 3 == k).withColumn("image_id", F.expr("image_id div 3")) for k in range(3)]).select("image_id", "t", "x", "y", r6("value").alias("value")),
    f"WITH {SQL_2D} SELECT image_id // 3 AS image_id, CAST(image_id % 3 AS INT) AS t, x, y, round(value, 6) + 0.0 AS value FROM img2d",
)
q(
    "p_reorient",
    lambda s, d: images.reoriented(img3d(s, d), {"x": "-y", "y": "z", "z": "x"}, {"x": 4, "y": 4, "z": 4}).select("image_id", "x", "y", "z", r6("value").alias("value")),
    f"WITH {SQL_3D} SELECT image_id, CAST(3 - y AS INT) AS x, z AS y, x AS z, round(value, 6) + 0.0 AS value FROM img3d",
)


# --- tensors
def _tensors(s, d):
    v = [F.col("embedding")[k].cast("double") for k in range(6)]
    return table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), *[((v[k] + 3.0) if k in (0, 2, 5) else v[k]).alias(f"d{k}") for k in range(6)])


_T = "t AS (SELECT vec_id AS image_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) + {3 if k in (0, 2, 5) else 0} AS d{k}" for k in range(6)) + " FROM embeddings)"
_DET = "d0 * (d2 * d5 - d4 * d4) - d1 * (d1 * d5 - d4 * d3) + d3 * (d1 * d4 - d2 * d3)"
q("p_tensor_log_exp", lambda s, d: regularise.tensor_log(_tensors(s, d)).select("image_id", r6(F.exp(F.col("d0") + F.col("d2") + F.col("d5"))).alias("det")), f"WITH {_T} SELECT image_id, round({_DET}, 6) + 0.0 AS det FROM t")


def _det():
    d = [F.col(f"d{k}") for k in range(6)]
    return d[0] * (d[2] * d[5] - d[4] * d[4]) - d[1] * (d[1] * d[5] - d[4] * d[3]) + d[3] * (d[1] * d[4] - d[2] * d[3])


q("p_tensor_exp", lambda s, d: regularise.tensor_exp(_tensors(s, d)).select("image_id", r6(F.ln(_det())).alias("trace")), f"WITH {_T} SELECT image_id, round(d0 + d2 + d5, 6) + 0.0 AS trace FROM t")
q(
    "p_tensor_rotate",
    lambda s, d: regularise.tensor_rotate(_tensors(s, d).withColumns({**{f"j{b}{a}": F.lit(float(a == b) * 1.5) for a in "xyz" for b in "xyz"}, "jxy": F.col("d1"), "jyx": -F.col("d1")})).select("image_id", *[r6(f"d{k}").alias(f"d{k}") for k in range(6)]),
    f"WITH {_T}, r AS (SELECT *, 1.5 / sqrt(2.25 + d1 * d1) AS c, d1 / sqrt(2.25 + d1 * d1) AS s FROM t) SELECT image_id, round(c*c*d0 + 2*c*s*d1 + s*s*d2, 6) + 0.0 AS d0, round(-c*s*d0 + (c*c - s*s)*d1 + c*s*d2, 6) + 0.0 AS d1, round(s*s*d0 - 2*c*s*d1 + c*c*d2, 6) + 0.0 AS d2, round(c*d3 + s*d4, 6) + 0.0 AS d3, round(c*d4 - s*d3, 6) + 0.0 AS d4, round(d5, 6) + 0.0 AS d5 FROM r",
)


# --- point spreads between resolutions
def _turned_points(s, d):
    """A regridding that stretches x by 0.8 and y by 1.3, as points with their Jacobian."""
    at = img2d(s, d).select(*ON, (F.col("x") * 0.8 + 0.3).alias("px"), (F.col("y") * 1.3 - 0.6).alias("py"))
    return at.withColumns({"jxx": F.lit(0.8), "jxy": F.lit(0.0), "jyx": F.lit(0.0), "jyy": F.lit(1.3)})


def _spread_sql(offsets: str) -> str:
    """offsets: rows of dx, dy (in the grid's space) and w."""
    return f"WITH {SQL_2D}, o AS ({offsets}), e AS (SELECT image_id, x, y, n, x * 0.8::DOUBLE + 0.3::DOUBLE + 0.8::DOUBLE * dx AS px, y * 1.3::DOUBLE - 0.6::DOUBLE + 1.3::DOUBLE * dy AS py, w FROM img2d, o), t AS (SELECT e.image_id, e.x, e.y, e.n, any_value(w) AS w, sum(s.value * {weights(1, '(px - floor(px))', 'i')} * {weights(1, '(py - floor(py))', 'j')}) AS v FROM e CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) JOIN img2d s ON s.image_id = e.image_id AND s.x = floor(px) + i AND s.y = floor(py) + j GROUP BY ALL), k AS (SELECT image_id, x, y, sum(v * w) / sum(w) AS value FROM t GROUP BY ALL) SELECT i.image_id, i.x, i.y, round(coalesce(k.value, CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM img2d i LEFT JOIN k USING (image_id, x, y)"


_T, _S = {"x": 1.1, "y": 0.9}, {"x": 0.3, "y": 0.4}
_EIGEN = [_T["x"] - _S["x"] / 0.8**2, _T["y"] - _S["y"] / 1.3**2]
_STEPS = f"SELECT i * 7 + j AS n, 0.75::DOUBLE * i * {_EIGEN[0] ** 0.5!r}::DOUBLE AS dx, 0.75::DOUBLE * j * {_EIGEN[1] ** 0.5!r}::DOUBLE AS dy, exp(-0.5 * 0.5625::DOUBLE * (i * i + j * j)) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE 0.5625 * (i * i + j * j) <= 9"
q("r_psf_between", lambda s, d: resample.psf_resample_between(img2d(s, d), _turned_points(s, d), KEY, AXES, AXES, _T, _S).select(*ON, r6("value").alias("value")), _spread_sql(_STEPS))
_SINC = [(k, -3 + 0.3 * k) for k in range(21)]
_SINC_W = "(CASE WHEN {v} = 0 THEN 1 WHEN abs({v}) >= 3 THEN 0 ELSE 3 * sin(pi() * {v}) * sin(pi() * {v} / 3) / pow(pi() * {v}, 2) END)"
_SHIFTS = "(VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in _SINC) + ")"
q(
    "r_psf_sinc",
    lambda s, d: resample.psf_resample_sinc(img2d(s, d), _turned_points(s, d), KEY, AXES, AXES).select(*ON, r6("value").alias("value")),
    _spread_sql(f"SELECT * FROM (SELECT a.k * 21 + b.k AS n, a.v AS dx, b.v AS dy, {_SINC_W.format(v='a.v')} * {_SINC_W.format(v='b.v')} AS w FROM {_SHIFTS} a(k, v), {_SHIFTS} b(k, v)) WHERE w > 0"),
)


# --- slopes of descriptors
def _descriptor_slope_sql(moves) -> str:
    n = len(moves)
    raw = _descriptor_sql(moves).replace("round(", "(").replace(", 6) + 0.0 AS d", ") AS d")
    slopes = ", ".join(f"(coalesce(lead(d{i}) OVER w{a}, 0) - coalesce(lag(d{i}) OVER w{a}, 0)) / 2 AS s{i}{a}" for i in range(n) for a in "xy")
    total = ", ".join("round(" + " + ".join(f"-2 * (a.d{i} - b.d{i}) / 64 * b.s{i}{a}" for i in range(n)) + f", 6) + 0.0 AS g{a}" for a in "xy")
    return f"WITH d AS MATERIALIZED ({raw}), s AS (SELECT *, {slopes} FROM d WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)) SELECT a.image_id, a.x, a.y, {total} FROM d a JOIN s b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y"


for _name, _context, _moves in (("e_mind_gradient", False, _MIND), ("e_mindssc_gradient", True, _SSC)):
    q(_name, lambda s, d, c=_context: _out(regularise.mind_gradient(img2d(s, d), _next(img2d(s, d)), KEY, AXES, c), "gx", "gy"), _descriptor_slope_sql(_moves))
