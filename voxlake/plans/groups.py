"""Queries of affine matrices in tables: a turn and a scale for each image, from two of its values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import estimate, matrices
from .estimates import POINT_PAIRS, matrix_rows, point_pairs
from .views import table

QUERIES = []
KEY = ["label"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def similarities(s, d):
    """image_id, label, m: turns about z by twice the first value, times a scale in x and y of exp(the second value)."""
    a, k = F.col("embedding")[0].cast("double") * 2, F.exp(F.col("embedding")[1].cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [k * F.cos(a), -k * F.sin(a), zero, zero, k * F.sin(a), k * F.cos(a), zero, zero, zero, zero, k, zero, zero, zero, zero, one]
    return table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.array(*m).alias("m"))


_S = "s AS (SELECT vec_id AS image_id, label, CAST(embedding[1] AS DOUBLE) * 2 AS a, CAST(embedding[2] AS DOUBLE) AS k FROM embeddings)"
PICKED = {"m00": 0, "m01": 1, "m10": 4, "m11": 5, "m22": 10}


def _entries(df, *keys):
    return df.select(*keys, *[r6(F.col("m")[at]).alias(n) for n, at in PICKED.items()])


def _sql(angle: str, scale: str, source: str, keys: str) -> str:
    at = {"m00": f"exp({scale}) * cos({angle})", "m01": f"-exp({scale}) * sin({angle})", "m10": f"exp({scale}) * sin({angle})", "m11": f"exp({scale}) * cos({angle})", "m22": f"exp({scale})"}
    return f"WITH {_S} SELECT {keys}, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in at.items()) + f" FROM {source}"


_MEANS = "(SELECT label, avg(a) AS a, avg(k) AS k FROM s GROUP BY 1)"
q("a_matrix_mean", lambda s, d: _entries(matrices.mean(similarities(s, d), KEY), "label"), _sql("a", "k", _MEANS, "label"))
q("a_matrix_demean", lambda s, d: _entries(matrices.demean(similarities(s, d), KEY), "label"), _sql("0", "-k", _MEANS, "label"))
q("a_matrix_trimmed_mean", lambda s, d: _entries(matrices.trimmed_mean(similarities(s, d), KEY, rounds=3), "label"))
q("t_half_affine", lambda s, d: _entries(matrices.half(similarities(s, d)), "image_id"), _sql("(a / 2)", "k / 2", "s", "image_id"))
q("t_rigid_part", lambda s, d: _entries(matrices.rigid_part(similarities(s, d)), "image_id"), _sql("a", "0", "s", "image_id"))
q("t_inverse_affine", lambda s, d: _entries(matrices.inverse(similarities(s, d)), "image_id"), _sql("(-a)", "-k", "s", "image_id"))
q(
    "t_update_world",
    lambda s, d: _entries(matrices.update_world(similarities(s, d), similarities(s, d).withColumn("image_id", F.col("image_id") - 1), ["image_id"]), "image_id"),
    _sql("(s.a - t.a)", "s.k - t.k", "s JOIN (SELECT image_id - 1 AS image_id, a, k FROM s) t USING (image_id)", "image_id"),
)
_AB = "a AS (SELECT *, (cxx * vyy - cyx * vxy) / (vxx * vyy - vxy * vxy) AS a00, (cyx * vxx - cxx * vxy) / (vxx * vyy - vxy * vxy) AS a01, (cxy * vyy - cyy * vxy) / (vxx * vyy - vxy * vxy) AS a10, (cyy * vxx - cxy * vxy) / (vxx * vyy - vxy * vxy) AS a11 FROM c)"
q(
    "e_affine_fit",
    lambda s, d: matrix_rows(s, estimate.trimmed_fit(point_pairs(s, d), 2, 100, rounds=1)),
    f"WITH {POINT_PAIRS}, c AS (SELECT covar_pop(rx, wx) AS cxx, covar_pop(ry, wx) AS cyx, covar_pop(rx, wy) AS cxy, covar_pop(ry, wy) AS cyy, var_pop(rx) AS vxx, var_pop(ry) AS vyy, covar_pop(rx, ry) AS vxy, avg(rx) AS mx, avg(ry) AS my, avg(wx) AS nx, avg(wy) AS ny FROM p), {_AB}, m AS (SELECT unnest([a00, a01, 0, nx - a00 * mx - a01 * my, a10, a11, 0, ny - a10 * mx - a11 * my, 0, 0, 1, 0, 0, 0, 0, 1]) AS v, unnest(range(16)) AS k FROM a) SELECT CAST(k // 4 AS INT) AS i, CAST(k % 4 AS INT) AS j, round(v, 6) + 0.0 AS v FROM m",
)
