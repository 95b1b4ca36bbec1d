"""Estimation and optimisation: least trimmed squares, measure gradients, descent steps, projections over time."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known, safe_div, valid
from . import matrix
from .lineage import cut
from .measures import defined
from .stencil import convolve_components

AX = ("x", "y", "z")
#: Bins of residuals in a pass, and residuals that the driver looks at.
BINS, FEW = 1 << 12, 1 << 14


def _sums(d: int) -> list:
    r, w = [F.col(f"r{a}") for a in AX[:d]], [F.col(f"w{a}") for a in AX[:d]]
    cols = [F.count(F.lit(1)).alias("n")]
    cols += [F.sum(c).alias(f"s{n}{i}") for n, v in (("r", r), ("w", w)) for i, c in enumerate(v)]
    cols += [F.sum(r[i] * r[j]).alias(f"rr{i}{j}") for i in range(d) for j in range(i, d)]
    return cols + [F.sum(r[i] * w[j]).alias(f"rw{i}{j}") for i in range(d) for j in range(d)]


def moments(pairs: DataFrame, d: int) -> DataFrame:
    """One row with the sums that a least-squares fit of w<axis> by r<axis> needs."""
    return pairs.agg(*_sums(d))


def _fit(m, d: int, rigid: bool) -> np.ndarray:
    sx, sy = np.array([m[f"sr{i}"] for i in range(d)]), np.array([m[f"sw{i}"] for i in range(d)])
    sxx = np.array([[m[f"rr{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)])
    sxy = np.array([[m[f"rw{i}{j}"] for j in range(d)] for i in range(d)])
    return (matrix.rigid_from_moments if rigid else matrix.affine_from_moments)(float(m["n"]), sx, sy, sxx, sxy)


def _kth_least(rows: DataFrame, k: int, low: float, high: float) -> float:
    """The k-th least value (from 1) of _e. Values are counted in bins between low and high, where it is expected; only
    those of its bin are looked at one by one."""
    while True:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("_e") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        binned = rows.withColumn("_b", F.when(F.col("_e") < low, F.lit(-1)).when(F.col("_e") > high, F.lit(BINS)).otherwise(place).cast("int"))
        before = 0
        for b, n in sorted((r["_b"], r["count"]) for r in binned.groupBy("_b").count().collect()):
            if before + n >= k:
                break
            before += n
        rows, k = binned.where(F.col("_b") == b).drop("_b"), k - before
        if n <= FEW:
            return sorted(r[0] for r in rows.select("_e").collect())[k - 1]
        low, high = rows.agg(F.min("_e"), F.max("_e")).first()
        if low == high:
            return low


#: Pairs that a fit needs: a rigid one, an affine one in two and in three dimensions.
LEAST = {True: {2: 4, 3: 4}, False: {2: 6, 3: 8}}


def trimmed_fit(pairs: DataFrame, d: int = 3, percent: float = 50, rigid: bool = False, rounds: int = 30, tolerance: float = 0.001) -> np.ndarray:
    """Least trimmed squares transformation from points r<axis> to w<axis>.

    All points are fitted first; then the given share with the least residuals is fitted again, until the sum of these
    squared residuals stops falling. A round counts residuals in bins, looks at the bin of the trim limit, and takes the
    moments and the sum of the kept pairs in one aggregate; only bins and sums reach the driver. The limit is the exact
    order statistic, with rows on the limit all taken.

    Pairs with a NaN or null don't count. With fewer pairs than LEAST, or none at all, the identity is returned.
    """
    names = [f"{p}{a}" for p in "rw" for a in AX[:d]]
    pairs = cut(pairs.select(*names).where(reduce(lambda p, q: p & q, [valid(c) for c in names])))
    first = moments(pairs, d).first()
    if first["n"] < LEAST[rigid][d]:
        return np.eye(4)
    now, last, limit = _fit(first, d, rigid), float("inf"), None
    keep = max(LEAST[rigid][d], int(first["n"] * percent / 100))
    before = now
    for _ in range(rounds):
        e = [reduce(lambda p, q: p + q, [F.col(f"r{AX[j]}") * float(now[i, j]) for j in range(d)]) + float(now[i, 3]) - F.col(f"w{AX[i]}") for i in range(d)]
        res = pairs.withColumn("_e", reduce(lambda p, q: p + q, [c * c for c in e]))
        if limit is None:
            low, high = res.agg(F.min("_e"), F.max("_e")).first()
        else:
            low, high = limit / 2, limit * 1.5
        limit = _kth_least(res, keep, low, high)
        got = res.where(F.col("_e") <= limit).agg(*_sums(d), F.sum("_e").alias("total")).first()
        if last - got["total"] < tolerance:
            return now if got["total"] <= last else before
        before, last = now, got["total"]
        now = _fit(got, d, rigid)
    return now


def ssd_gradient(pair: DataFrame, keys: list[str], axes: list[str], factor: float = 1.0) -> DataFrame:
    """g<axis> of a pair that carries the warped image's gradient s<axis>: -2 (r - w) s / number of voxels."""
    n = pair.groupBy(*keys).agg(F.count(known(F.col("value") + F.col("w"))).alias("_n"))
    k = -2.0 * factor * (F.col("value") - F.col("w")) / F.col("_n")
    return pair.join(n, keys).withColumns({f"g{a}": F.coalesce(known(k * F.col(f"s{a}")), F.lit(0.0)) for a in axes}).drop("_n")


def kld_gradient(pair: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Slope of the divergence: (r / w) s / number of voxels."""
    n = pair.groupBy(*keys).agg(F.count(known(F.col("value") + F.col("w"))).alias("_n"))
    k = safe_div(F.col("value") + 1e-16, F.col("w") + 1e-16) / F.col("_n")
    return pair.join(n, keys).withColumns({f"g{a}": F.coalesce(known(k * F.col(f"s{a}")), F.lit(0.0)) for a in axes}).drop("_n")


def lncc_gradient(pair: DataFrame, keys: list[str], axes: list[str], sigma: float = -5.0, kind: str = "gauss") -> DataFrame:
    """g<axis> of the mean absolute local correlation of value and w, with slopes s<axis> of w.

    Local moments are convolved; three maps of what a voxel's value adds to the correlations around it are made of them,
    convolved again, and meet the voxel's own values. Voxels whose local deviations are 0 say nothing.
    """
    s = dict.fromkeys(axes, sigma)
    v, w = F.col("value"), F.col("w")
    ok = valid(v) & valid(w)
    maps = {"_r": v, "_f": w, "_rr": v * v, "_ff": w * w, "_rf": v * w}
    made = pair.withColumns({n: F.when(ok, c).otherwise(F.lit(float("nan"))) for n, c in maps.items()}).withColumns({"_own": v, "_other": w}).drop("value")
    local = convolve_components(made, keys, axes, s, list(maps), kind)
    dev = lambda a, b: F.sqrt(F.greatest(F.col(b) - F.col(a) * F.col(a), F.lit(0.0)))
    local = local.withColumns({"_sr": dev("_r", "_rr"), "_sf": dev("_f", "_ff"), "_c": F.col("_rf") - F.col("_r") * F.col("_f")})
    good = (F.col("_sr") >= 1e-6) & (F.col("_sf") >= 1e-6)
    sign = F.when(F.col("_c") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    first = sign / (F.col("_sr") * F.col("_sf"))
    second = first * F.col("_c") / (F.col("_sf") * F.col("_sf"))
    third = second * F.col("_f") - first * F.col("_r")
    terms = {"_1": first, "_2": second, "_3": third}
    drawn = local.withColumns({n: F.when(F.isnan("_c"), F.lit(float("nan"))).when(good, c).otherwise(F.lit(0.0)) for n, c in terms.items()}).withColumn("_good", good & ~F.isnan("_c"))
    n = drawn.groupBy(*keys).agg(F.sum(F.col("_good").cast("long")).alias("_n"))
    around = convolve_components(drawn, keys, axes, s, list(terms), kind).join(n, keys)
    k = (F.col("_1") * F.col("_own") - F.col("_2") * F.col("_other") + F.col("_3")) / F.col("_n")
    return around.select(*keys, *axes, *[F.coalesce(known(-k * F.col(f"s{a}")), F.lit(0.0)).alias(f"g{a}") for a in axes])


def nmi_gradient(pair: DataFrame, histogram: DataFrame, keys: list[str], axes: list[str], point: list[str]) -> DataFrame:
    """g<axis> of the normalised mutual information of a binned pair with slopes s<axis>.

    The histogram (keys, r, f, h) is turned into what each bin adds to the gradient first, a few thousand rows a pair. It
    is a lattice over r and f: each voxel reads it at its two values, with the spline's slope along f, so that voxels and
    bins meet on tiles and no row is made for a voxel and a bin.
    """
    from pyspark.sql import Window as W

    from .lattice import lattice_sums

    image = W.partitionBy(*keys)
    total = F.sum("h").over(image)
    p = histogram.where("h > 0").withColumn("p", F.col("h") / total).withColumn("_mass", total)
    p = p.withColumn("lr", F.ln(F.sum("p").over(W.partitionBy(*keys, "r")))).withColumn("lf", F.ln(F.sum("p").over(W.partitionBy(*keys, "f")))).withColumn("lrf", F.ln("p"))
    sides = F.col("lr") + F.col("lf")
    p = p.withColumns({"_hrf": -F.sum(F.col("p") * F.col("lrf")).over(image), "_both": -F.sum(F.col("p") * sides).over(image)})
    bins = p.select(*keys, "r", "f", ((sides - F.col("_both") / F.col("_hrf") * F.col("lrf")) / (F.col("_hrf") * F.col("_mass"))).alias("_k"))
    slopes = [f"s{a}" for a in axes]
    at = defined(pair).select(*keys, *point, *slopes, F.col("value").alias("qr"), F.col("w").alias("qf"))
    got = lattice_sums(at, bins, keys, [*point, *slopes], ["r", "f"], [("f", {"_k": "_g"})])
    return got.select(*keys, *point, *[(F.col("_g") * F.col(f"s{a}")).alias(f"g{a}") for a in axes])


def normalise_gradient(gradient: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Vectors divided by the length of the longest."""
    length = F.sqrt(reduce(lambda p, q: p + q, [F.col(v) * F.col(v) for v in parts]))
    most = gradient.groupBy(*keys).agg(F.max(length).alias("_m"))
    return gradient.join(most, keys).withColumns({v: safe_div(F.col(v), F.col("_m")) for v in parts}).drop("_m")


def step(nodes: DataFrame, gradient: DataFrame, on: list[str], parts: list[str], scale: float) -> DataFrame:
    """Nodes moved along the gradient."""
    g = gradient.select(*on, *[F.col(v).alias(f"_g{v}") for v in parts])
    return nodes.join(g, on, "left").withColumns({v: F.col(v) + scale * F.coalesce(f"_g{v}", F.lit(0.0)) for v in parts}).drop(*[f"_g{v}" for v in parts])


def update_velocity(nodes: DataFrame, gradient: DataFrame, on: list[str], parts: list[str], scale: float, optimise: dict[str, bool] | None = None) -> DataFrame:
    """Velocity grid moved along the gradient; components that aren't to be optimised stay."""
    free = [v for v in parts if (optimise or {}).get(v, True)]
    return step(nodes, gradient, on, free, scale)


def symmetrised(forward: DataFrame, backward: DataFrame, on: list[str], parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Velocities (displacements) of both directions, each half of itself less the other, so that they are inverse."""
    other = lambda df: df.select(*on, *[F.col(v).alias(f"_o{v}") for v in parts])
    half = lambda a, b: a.join(other(b), on).withColumns({v: (F.col(v) - F.col(f"_o{v}")) / 2 for v in parts}).select(*on, *parts)
    return half(forward, backward), half(backward, forward)


def exponentiated_gradient(gradient: DataFrame, fields: list[DataFrame], keys: list[str], axes: list[str]) -> DataFrame:
    """Gradient of a velocity field from that of its deformation: for each squaring's field (positions), the gradient is
    read where it leads, turned by its Jacobian and added; divided by two for each squaring."""
    from .transform import PARTS, field_jacobian, parts_of, resample_vectors

    now = gradient.select(*keys, *axes, *parts_of(axes))
    for f in fields:
        at = field_jacobian(f, keys, axes).withColumns({f"p{a}": F.col(PARTS[a]) for a in axes}).drop("det", *parts_of(axes))
        moved = resample_vectors(now, at, keys, axes, axes).select(*keys, *axes, *[F.col(v).alias(f"_m{v}") for v in parts_of(axes)])
        now = cut(now.join(moved, [*keys, *axes]).select(*keys, *axes, *[(F.col(v) + F.col(f"_m{v}")).alias(v) for v in parts_of(axes)]))
    return now.withColumns({v: F.col(v) / float(2 ** len(fields)) for v in parts_of(axes)})


def conjugate(gradient: DataFrame, before: DataFrame, keys: list[str], on: list[str], parts: list[str]) -> DataFrame:
    """Polak-Ribiere direction. before: the last gradient p<part> and direction h<part>; the result has both anew."""
    both = gradient.join(before, on)
    add = lambda f: reduce(lambda p, q: p + q, [f(v) for v in parts])
    sums = both.groupBy(*keys).agg(F.sum(add(lambda v: (F.col(v) - F.col(f"p{v}")) * F.col(v))).alias("_a"), F.sum(add(lambda v: F.col(f"p{v}") * F.col(f"p{v}"))).alias("_b"))
    gamma = F.greatest(safe_div(F.col("_a"), F.col("_b")), F.lit(0.0))
    return both.join(sums, keys).select(*on, *[F.col(v).alias(f"p{v}") for v in parts], *[(F.col(v) + gamma * F.col(f"h{v}")).alias(f"h{v}") for v in parts])


def line_search(objective, start: float, best: float, most: int = 12, grow: float = 1.1, shrink: float = 0.5) -> tuple[float, float]:
    """Total step and value: the step grows while the objective rises, is halved where it doesn't, at most 12 trials."""
    done, size = 0.0, start
    for _ in range(most):
        value = objective(done + size)
        if value > best:
            done, best, size = done + size, value, size * grow
        else:
            size *= shrink
    return done, best


def perturbed(nodes: DataFrame, parts: list[str], reach: float, seed: int) -> DataFrame:
    return nodes.withColumns({v: F.col(v) + reach * (2 * F.rand(seed + k) - 1) for k, v in enumerate(parts)})


def project_over_time(a: DataFrame, keys: list[str], voxel: list[str], cov: DataFrame, count: int) -> DataFrame:
    """Each voxel's series rebuilt from the leading principal parts of the time covariance (t, u, cov) of its key.

    Covariances are a few rows a key; the projection is computed for each key in its own task and joined back.
    """

    def parts(pdf):
        n = int(max(pdf["t"].max(), pdf["u"].max())) + 1
        c = np.zeros((n, n))
        c[pdf["t"], pdf["u"]] = pdf["cov"]
        p = matrix.principal_parts(c, count)
        out = pdf.assign(k=p[pdf["t"], pdf["u"]])
        return out[[*keys, "t", "u", "k"]]

    schema = ", ".join(f"{k} {dict(cov.dtypes)[k]}" for k in keys) + ", t int, u int, k double"
    share = cov.groupBy(*keys).applyInPandas(parts, schema)
    mean = a.groupBy(*keys, "t").agg(F.avg("value").alias("_m"))
    centred = a.join(mean, [*keys, "t"]).select(*keys, *voxel, F.col("t").alias("u"), (F.col("value") - F.col("_m")).alias("_c"))
    got = centred.join(share, [*keys, "u"]).groupBy(*keys, *voxel, "t").agg(F.sum(F.col("_c") * F.col("k")).alias("_v"))
    return got.join(mean, [*keys, "t"]).select(*keys, "t", *voxel, (F.col("_v") + F.col("_m")).alias("value"))
