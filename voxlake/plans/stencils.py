"""Queries of the stencil operators and the ordered selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import select as k
from ..operators import stencil as c
from .measuring import pairs
from .points import HOLES, ON, PAIRS, _holes
from .views import SQL_2D, SQL_3D, SQL_4D, img2d, img3d, img4d, table

QUERIES = []
KEY, AXES = ["image_id"], ["x", "y"]


def q(name, fn, sql=None):
    QUERIES.append((name, fn, sql))


def _v(df, *cols):
    return df.select(*(cols or ON), r6("value").alias("value"))


def kernel_values(kind: str, sigma: float) -> str:
    k_ = c.kernel(kind, sigma)
    r = len(k_) // 2
    return "(VALUES " + ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in zip(range(-r, r + 1), k_, strict=True)) + ")"


def conv_sql(kind: str, sigma: float, axes=("x", "y"), base=HOLES, source="holes") -> str:
    steps = [f"s0 AS (SELECT *, CASE WHEN isnan(value) THEN 0 ELSE value END AS v, CASE WHEN isnan(value) THEN 0.0 ELSE 1.0 END::DOUBLE AS d FROM {source})"]
    for n, a in enumerate(axes):
        cols = ", ".join(x if x != a else f"a.{x}" for x in axes)
        on = " AND ".join(f"a.{x} = b.{x}" for x in axes if x != a)
        cols = ", ".join(f"a.{x}" for x in axes)
        steps.append(f"s{n + 1} AS (SELECT a.image_id, {cols}, any_value(a.value) AS value, sum(k.k * b.v) AS v, sum(k.k * b.d) AS d FROM s{n} a CROSS JOIN {kernel_values(kind, sigma)} k(i, k) JOIN s{n} b ON a.image_id = b.image_id AND {on} AND b.{a} = a.{a} + k.i GROUP BY a.image_id, {cols})")
    return f"WITH {base}, {', '.join(steps)} SELECT image_id, {', '.join(axes)}, round(CASE WHEN isnan(value) THEN value ELSE v / d END, 6) + 0.0 AS value FROM s{len(axes)}"


for _kind, _s in (("gauss", 1.2), ("cubic", 1.5), ("linear", 3.0), ("mean", 2.0)):
    q(f"c_{_kind}", lambda s, d, kind=_kind, sig=_s: _v(c.convolve(_holes(img2d(s, d)), KEY, AXES, {"x": -sig, "y": -sig}, kind)), conv_sql(_kind, _s))
q("c_gauss_3d", lambda s, d: _v(c.convolve(img3d(s, d), KEY, ["x", "y", "z"], dict.fromkeys("xyz", -0.7)), "image_id", "x", "y", "z"), conv_sql("gauss", 0.7, ("x", "y", "z"), SQL_3D, "img3d"))
q(
    "c_label",
    lambda s, d: _v(c.label_filter(img2d(s, d).withColumn("value", F.floor(F.col("value") * 8).cast("double")), KEY, AXES, 1.0)),
    f"WITH {SQL_2D}, l AS (SELECT *, floor(value * 8) AS label FROM img2d), k AS (SELECT * FROM {kernel_values('gauss', 1.0)} k(i, k)), v AS (SELECT a.image_id, a.x, a.y, b.label, round(sum(k1.k * k2.k), 12) AS vote FROM l a CROSS JOIN k k1 CROSS JOIN k k2 JOIN l b ON a.image_id = b.image_id AND b.x = a.x + k1.i AND b.y = a.y + k2.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY vote DESC, label) AS n FROM v) SELECT image_id, x, y, round(label, 6) + 0.0 AS value FROM r WHERE n = 1",
)
q(
    "c_gradient",
    lambda s, d: c.gradient(img2d(s, d), KEY, AXES, 0.25).select(*ON, r6("gx").alias("gx"), r6("gy").alias("gy")),
    f"WITH {SQL_2D} SELECT image_id, x, y, round((coalesce(lead(value) OVER a, 0.25) - coalesce(lag(value) OVER a, 0.25)) / 2, 6) + 0.0 AS gx, round((coalesce(lead(value) OVER b, 0.25) - coalesce(lag(value) OVER b, 0.25)) / 2, 6) + 0.0 AS gy FROM img2d WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y)",
)
q("c_shift", lambda s, d: _v(c.shift(img2d(s, d), KEY, AXES, {"x": 2, "y": -1})), f"WITH {SQL_2D} SELECT a.image_id, a.x, a.y, round(coalesce(b.value, 0), 6) + 0.0 AS value FROM img2d a LEFT JOIN img2d b ON a.image_id = b.image_id AND b.x = a.x + 2 AND b.y = a.y - 1")
q(
    "c_locality",
    lambda s, d: _v(c.local_mean(img4d(s, d), ["series_id"], AXES, 1), "series_id", "t", "x", "y"),
    f"WITH {SQL_4D} SELECT series_id, t, x, y, round(avg(value) OVER (PARTITION BY series_id, x, y ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS value FROM img4d",
)
q(
    "c_series_gauss",
    lambda s, d: _v(c.convolve(_series(s, d), ["user_id"], ["t"], {"t": -2.0}), "user_id", "t"),
    f"WITH s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS t, value FROM events) SELECT a.user_id, a.t, round(sum(k.k * b.value) / sum(k.k), 6) + 0.0 AS value FROM s a CROSS JOIN {kernel_values('gauss', 2.0)} k(i, k) JOIN s b ON a.user_id = b.user_id AND b.t = a.t + k.i GROUP BY a.user_id, a.t",
)


def _series(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "events")
    return e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("t"), "value")


def _descriptor_sql(moves: list[tuple[tuple, tuple]]) -> str:
    n = len(moves)
    k_ = kernel_values("gauss", 0.5)
    at = lambda m: f"coalesce((SELECT b.value FROM img2d b WHERE b.image_id = a.image_id AND b.x = a.x + {m[0]} AND b.y = a.y + {m[1]}), 0)"
    sq = ", ".join(f"pow({at(p)} - {at(r)}, 2) AS d{i}" for i, (p, r) in enumerate(moves))
    sm = lambda src, axis: f"SELECT a.image_id, a.x, a.y, " + ", ".join(f"sum(k.k * b.d{i}) AS d{i}" for i in range(n)) + f", sum(k.k * b.o) AS o FROM {src} a CROSS JOIN {k_} k(i, k) JOIN {src} b ON a.image_id = b.image_id AND b.x = a.x + {'k.i' if axis == 'x' else '0'} AND b.y = a.y + {'k.i' if axis == 'y' else '0'} GROUP BY a.image_id, a.x, a.y"
    mean = "(" + " + ".join(f"d{i} / o" for i in range(n)) + f") / {n}"
    return f"WITH {SQL_2D}, s0 AS (SELECT a.image_id, a.x, a.y, 1.0::DOUBLE AS o, {sq} FROM img2d a), s1 AS ({sm('s0', 'x')}), s2 AS ({sm('s1', 'y')}), e AS (SELECT image_id, x, y, " + ", ".join(f"exp(-(d{i} / o) / CASE WHEN {mean} = 0 THEN 2.220446049250313e-16 ELSE {mean} END) AS e{i}" for i in range(n)) + " FROM s2) SELECT image_id, x, y, " + ", ".join(f"round(e{i} / greatest({', '.join(f'e{j}' for j in range(n))}), 6) + 0.0 AS d{i}" for i in range(n)) + " FROM e"


_MIND = [((0, 0), (s * (a == 0), s * (a == 1))) for a in (0, 1) for s in (-1, 1)]
_SSC = [((s, 0), (0, t)) for s in (-1, 1) for t in (-1, 1)]
q("d_mind", lambda s, d: c.mind(img2d(s, d), KEY, AXES).select(*ON, *[r6(f"d{i}").alias(f"d{i}") for i in range(4)]), _descriptor_sql(_MIND))
q("d_mindssc", lambda s, d: c.mind_ssc(img2d(s, d), KEY, AXES).select(*ON, *[r6(f"d{i}").alias(f"d{i}") for i in range(4)]), _descriptor_sql(_SSC))


def _lncc_sql() -> str:
    names = ("r", "f", "rr", "ff", "rf", "n")
    step = lambda src, axis: "SELECT a.image_id, a.x, a.y, " + ", ".join(f"sum(k.k * b.{n}) AS {n}" for n in names) + f" FROM {src} a CROSS JOIN {kernel_values('gauss', 2.0)} k(i, k) JOIN {src} b ON a.image_id = b.image_id AND b.x = a.x + {'k.i' if axis == 'x' else '0'} AND b.y = a.y + {'k.i' if axis == 'y' else '0'} GROUP BY a.image_id, a.x, a.y"
    return f"WITH {PAIRS}, s0 AS (SELECT image_id, x, y, value AS r, w AS f, value * value AS rr, w * w AS ff, value * w AS rf, 1.0::DOUBLE AS n FROM pairs), s1 AS ({step('s0', 'x')}), s2 AS ({step('s1', 'y')}), m AS (SELECT image_id, sqrt(greatest(rr / n - pow(r / n, 2), 0)) AS sr, sqrt(greatest(ff / n - pow(f / n, 2), 0)) AS sf, rf / n - r / n * f / n AS c FROM s2) SELECT image_id, round(avg(abs(c / (sr * sf))), 6) + 0.0 AS measure FROM m WHERE sr >= 1e-6 AND sf >= 1e-6 GROUP BY 1"


q("a_lncc", lambda s, d: c.lncc(pairs(s, d), KEY, AXES, -2.0).select("image_id", r6("measure").alias("measure")), _lncc_sql())
q(
    "k_top_blocks",
    lambda s, d: k.top_blocks(img2d(s, d), KEY, AXES, 50).select("image_id", "bx", "by", "place", r6("variance").alias("variance")),
    f"WITH {SQL_2D}, b AS (SELECT image_id, CAST(x // 4 AS INT) AS bx, CAST(y // 4 AS INT) AS \"by\", var_pop(value) AS variance FROM img2d GROUP BY ALL HAVING var_pop(value) > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY variance DESC, \"by\", bx) AS INT) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM b) SELECT image_id, bx, \"by\", place, round(variance, 6) + 0.0 AS variance FROM r WHERE place <= n * 50 // 100",
)
q(
    "k_lts_trim",
    lambda s, d: k.trim(pairs(s, d).withColumn("residual", F.abs(F.col("value") - F.col("w"))), KEY, ["y", "x"], 50).select(*ON, r6("residual").alias("residual")),
    f"WITH {PAIRS}, r AS (SELECT *, abs(value - w) AS residual, row_number() OVER (PARTITION BY image_id ORDER BY abs(value - w), y, x) AS n FROM pairs) SELECT image_id, x, y, round(residual, 6) + 0.0 AS residual FROM r WHERE n <= 32",
)
q(
    "k_robust_range",
    lambda s, d: k.robust_range(img2d(s, d), KEY).select("image_id", r6("low").alias("low"), r6("high").alias("high")),
    f"WITH {SQL_2D}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY value) - 1 AS r FROM img2d) SELECT image_id, round(max(value) FILTER (WHERE r = 1), 6) + 0.0 AS low, round(max(value) FILTER (WHERE r = 63), 6) + 0.0 AS high FROM r GROUP BY 1",
)
q(
    "k_block_match",
    lambda s, d: k.match_blocks(img2d(s, d), pairs(s, d).select(*ON, F.col("w").alias("value")), KEY, AXES, k.top_blocks(img2d(s, d), KEY, AXES, 50), 2).select("image_id", "bx", "by", "dx", "dy", r6("ncc").alias("ncc")),
    f"WITH {PAIRS}, b AS (SELECT image_id, CAST(x // 4 AS INT) AS bx, CAST(y // 4 AS INT) AS \"by\", var_pop(value) AS variance FROM img2d GROUP BY ALL HAVING var_pop(value) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY variance DESC, \"by\", bx) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM b), top AS (SELECT image_id, bx, \"by\" FROM r WHERE place <= n * 50 // 100), c AS (SELECT t.image_id, t.bx, t.\"by\", CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(abs(corr(i.value, p.w)), 9) AS ncc FROM top t JOIN img2d i ON i.image_id = t.image_id AND i.x // 4 = t.bx AND i.y // 4 = t.\"by\" CROSS JOIN range(-2, 3) a(dx) CROSS JOIN range(-2, 3) e(dy) JOIN pairs p ON p.image_id = i.image_id AND p.x = i.x + dx AND p.y = i.y + dy GROUP BY ALL HAVING count(*) > 8), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, bx, \"by\" ORDER BY ncc DESC, dy, dx) AS n FROM c WHERE NOT isnan(ncc)) SELECT image_id, bx, \"by\", dx, dy, round(ncc, 6) + 0.0 AS ncc FROM o WHERE n = 1",
)
