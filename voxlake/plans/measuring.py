"""Queries of the measures and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import measures as m
from .points import HOLES, M, ON, PAIRS, _holes, _next
from .views import SQL_2D, SQL_3D, SQL_4D, img2d, img3d, img4d, table

QUERIES = []
KEY = ["image_id"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def pairs(s, d, holes=False):
    a = img2d(s, d)
    b = _next(a).withColumnRenamed("value", "w")
    return (_holes(a) if holes else a).join(b, ON)


def _m(df, *keys, value="measure"):
    return df.select(*(keys or KEY), r6(value).alias(value))


HP = f"{HOLES}, pairs AS (SELECT a.image_id, a.x, a.y, a.value, b.value AS w FROM holes a JOIN img2d b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y WHERE NOT isnan(a.value))"
BINNED = f"{PAIRS}, lim AS (SELECT image_id, min(value) AS rl, max(value) AS rh, min(w) AS wl, max(w) AS wh FROM pairs GROUP BY 1), b AS (SELECT image_id, (value - rl) / (rh - rl) * 15 + 2 AS value, (w - wl) / (wh - wl) * 15 + 2 AS w FROM pairs JOIN lim USING (image_id))"
ENTROPY = "t AS (SELECT *, h / sum(h) OVER (PARTITION BY image_id) AS p FROM hist WHERE h > 0), hrf AS (SELECT image_id, -sum(p * ln(p)) AS v FROM t GROUP BY 1), hr AS (SELECT image_id, -sum(p * ln(p)) AS v FROM (SELECT image_id, r, sum(p) AS p FROM t GROUP BY ALL) GROUP BY 1), hf AS (SELECT image_id, -sum(p * ln(p)) AS v FROM (SELECT image_id, f, sum(p) AS p FROM t GROUP BY ALL) GROUP BY 1) SELECT hrf.image_id, round((hr.v + hf.v) / hrf.v, 6) + 0.0 AS measure FROM hrf JOIN hr USING (image_id) JOIN hf USING (image_id)"
BS = lambda e: f"(CASE WHEN abs({e}) < 1 THEN 2.0::DOUBLE / 3 + (abs({e}) / 2 - 1) * ({e}) * ({e}) WHEN abs({e}) < 2 THEN pow(2 - abs({e}), 3) / 6 ELSE 0 END)"
SMOOTH = "(VALUES (-1, 1.0::DOUBLE / 6), (0, 2.0::DOUBLE / 3), (1, 1.0::DOUBLE / 6)) k(d, k)"

q("a_ssd", lambda s, d: _m(m.ssd(pairs(s, d, True), KEY)), f"WITH {HP} SELECT image_id, round(-sum((value - w) * (value - w)) / count(*), 6) + 0.0 AS measure FROM pairs GROUP BY 1")
q("a_ssd_weighted", lambda s, d: _m(m.ssd(pairs(s, d), KEY, F.col("x") + 0.5, 2.0)), f"WITH {PAIRS} SELECT image_id, round(-2 * sum((value - w) * (value - w) * (x + 0.5::DOUBLE)) / sum(x + 0.5::DOUBLE), 6) + 0.0 AS measure FROM pairs GROUP BY 1")
q(
    "a_ssd_normalised",
    lambda s, d: _m(m.ssd(m.jointly_normalised(pairs(s, d), KEY), KEY)),
    f"WITH {PAIRS}, lim AS (SELECT image_id, least(min(value), min(w)) AS lo, greatest(max(value), max(w)) AS hi FROM pairs GROUP BY 1) SELECT image_id, round(-avg(pow((value - w) / (hi - lo), 2)), 6) + 0.0 AS measure FROM pairs JOIN lim USING (image_id) GROUP BY 1",
)
q(
    "a_nmi_value",
    lambda s, d: _m(m.nmi(pairs(s, d), KEY, 20)),
    f"WITH {BINNED}, c AS (SELECT image_id, CAST(floor(value) AS INT) AS r, CAST(floor(w) AS INT) AS f, count(*)::DOUBLE AS h FROM b GROUP BY ALL), c1 AS (SELECT image_id, r + d AS r, f, sum(h * k) AS h FROM c, {SMOOTH} GROUP BY ALL), hist AS (SELECT image_id, r, f + d AS f, sum(h * k) AS h FROM c1, {SMOOTH} GROUP BY ALL), {ENTROPY}",
)
q(
    "a_nmi_exact",
    lambda s, d: _m(m.nmi(pairs(s, d), KEY, 20, exact=True)),
    f"WITH {BINNED}, hist AS (SELECT image_id, CAST(floor(value) AS INT) + i AS r, CAST(floor(w) AS INT) + j AS f, sum({BS('(value - floor(value) - i)')} * {BS('(w - floor(w) - j)')}) AS h FROM b, range(-1, 3) a(i), range(-1, 3) c(j) GROUP BY ALL), {ENTROPY}",
)


def _points(s, d):
    """Price and quantity of line items as points, with one key for all."""
    return table(s, d, "lineitem").select(F.lit(0).alias("image_id"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("w"))


q(
    "a_nmi_hist",
    lambda s, d: m.joint_histogram(m.in_bins(_points(s, d), KEY), KEY).select("r", "f", r6("h").alias("h")),
    f"WITH lim AS (SELECT min(l_extendedprice) AS rl, max(l_extendedprice) AS rh, min(l_quantity) AS wl, max(l_quantity) AS wh FROM lineitem), c AS (SELECT CAST(floor((l_extendedprice - rl) / (rh - rl) * 63 + 2) AS INT) AS r, CAST(floor((l_quantity - wl) / (wh - wl) * 63 + 2) AS INT) AS f, count(*)::DOUBLE AS h FROM lineitem, lim GROUP BY ALL), c1 AS (SELECT r + d AS r, f, sum(h * k) AS h FROM c, {SMOOTH} GROUP BY ALL) SELECT r, f + d AS f, round(sum(h * k), 6) + 0.0 AS h FROM c1, {SMOOTH} GROUP BY ALL",
)
q(
    "a_kld",
    lambda s, d: _m(m.kld(pairs(s, d).withColumns({"value": F.abs("value"), "w": F.abs("w")}), KEY)),
    f"WITH {PAIRS} SELECT image_id, round(-avg((abs(value) + 1e-16) * ln((abs(value) + 1e-16) / (abs(w) + 1e-16))), 6) + 0.0 AS measure FROM pairs GROUP BY 1",
)
q("a_ncc", lambda s, d: _m(m.ncc(pairs(s, d, True), KEY)), f"WITH {HP} SELECT image_id, round(corr(value, w), 6) + 0.0 AS measure FROM pairs GROUP BY 1")
q("a_rms", lambda s, d: _m(m.rms(pairs(s, d), KEY, ["x"])), f"WITH {PAIRS} SELECT image_id, round(avg(v), 6) + 0.0 AS measure FROM (SELECT image_id, x, sqrt(sum((value - w) * (value - w))) AS v FROM pairs GROUP BY ALL) GROUP BY 1")
q(
    "a_mean_std",
    lambda s, d: m.statistics(_holes(img2d(s, d)), KEY, 2.0, 1.0).select("image_id", *[r6(c).alias(c) for c in ("lo", "hi", "mean", "std")]),
    f"WITH {HOLES} SELECT image_id, round(min(value) * 2 + 1, 6) + 0.0 AS lo, round(max(value) * 2 + 1, 6) + 0.0 AS hi, round(avg(value) * 2 + 1, 6) + 0.0 AS mean, round(stddev_pop(value) * 2, 6) + 0.0 AS std FROM holes WHERE NOT isnan(value) GROUP BY 1",
)
q(
    "a_dti",
    lambda s, d: _m(m.dti_distance(_tensors(s, d), KEY)),
    f"WITH {PAIRS}, t AS (SELECT image_id, y, " + ", ".join(f"max(value - w) FILTER (WHERE x = {k}) AS d{k}" for k in range(6)) + " FROM pairs GROUP BY ALL) SELECT image_id, round(-avg(2.0::DOUBLE / 3 * (d0*d0 + d2*d2 + d5*d5) + 2 * (d1*d1 + d3*d3 + d4*d4) - 2.0::DOUBLE / 3 * (d0*d2 + d0*d5 + d2*d5)), 6) + 0.0 AS measure FROM t GROUP BY 1",
)


def _tensors(s, d):
    """Columns x = 0..5 of each line read as the six channels of a tensor."""
    return pairs(s, d).groupBy("image_id", "y").agg(*[F.max(F.when(F.col("x") == k, F.col(c))).alias(f"{n}{k}") for k in range(6) for c, n in (("value", "r"), ("w", "w"))])


q("a_maxlen", lambda s, d: _m(m.longest(pairs(s, d), KEY, ["value", "w"]), value="length"), f"WITH {PAIRS} SELECT image_id, round(max(sqrt(value * value + w * w)), 6) + 0.0 AS length FROM pairs GROUP BY 1")
q(
    "a_com",
    lambda s, d: m.centre_of_mass(img2d(s, d).withColumn("value", F.abs("value")), KEY, M).select("image_id", *[r6(c).alias(c) for c in ("cx", "cy", "cz")]),
    f"WITH {SQL_2D}, c AS (SELECT image_id, sum(x * abs(value)) / sum(abs(value)) AS a, sum(y * abs(value)) / sum(abs(value)) AS b FROM img2d GROUP BY 1) SELECT image_id, round(2 * a + 0.5 * b - 3, 6) + 0.0 AS cx, round(-0.25 * a + 1.5 * b + 4, 6) + 0.0 AS cy, 1.0::DOUBLE AS cz FROM c",
)
q(
    "a_block_variance",
    lambda s, d: m.block_variance(_holes(img2d(s, d)), KEY, ["x", "y"]).select("image_id", "bx", "by", "n", r6("mean").alias("mean"), r6("variance").alias("variance"), "usable"),
    f"WITH {HOLES} SELECT image_id, CAST(x // 4 AS INT) AS bx, CAST(y // 4 AS INT) AS by, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance, count(*) > 8 AND var_pop(value) > 0 AS usable FROM holes WHERE NOT isnan(value) GROUP BY ALL",
)
q("a_average_nan", lambda s, d: _m(m.nan_average(_holes(img2d(s, d)), ["x", "y"]), "x", "y", value="value"), f"WITH {HOLES} SELECT x, y, round(coalesce(avg(value) FILTER (WHERE NOT isnan(value)), CAST('nan' AS DOUBLE)), 6) + 0.0 AS value FROM holes GROUP BY ALL")
q(
    "a_cov_time",
    lambda s, d: m.time_covariance(img4d(s, d), ["series_id"], ["x", "y"]).select("series_id", "t", "u", r6("cov").alias("cov")),
    f"WITH {SQL_4D} SELECT a.series_id, a.t, b.t AS u, round(covar_pop(a.value, b.value), 6) + 0.0 AS cov FROM img4d a JOIN img4d b ON a.series_id = b.series_id AND a.x = b.x AND a.y = b.y GROUP BY ALL",
)
q(
    "a_weighted_measures",
    lambda s, d: _m(m.weighted_sum([(m.ssd(pairs(s, d), KEY), 0.3), (m.ncc(pairs(s, d), KEY), 0.7)], KEY)),
    f"WITH {PAIRS} SELECT image_id, round(0.3 * -avg((value - w) * (value - w)) + 0.7 * corr(value, w), 6) + 0.0 AS measure FROM pairs GROUP BY 1",
)
q("a_minmax_3d", lambda s, d: m.statistics(img3d(s, d), ["image_id", "z"]).select("image_id", "z", r6("lo").alias("lo"), r6("hi").alias("hi")), f"WITH {SQL_3D} SELECT image_id, z, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi FROM img3d GROUP BY ALL")
