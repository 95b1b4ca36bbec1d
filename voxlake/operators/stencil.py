"""Stencils: separable convolution, label filter, gradients, shifts and self-similarity descriptors.

Convolutions and the label filter work on tiles (tiles.py), all axes and components in one exchange. Gradients and shifts
are windows along the lines of an image: each task holds one line's frame at a time. Descriptors shift, then convolve.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import known, safe_div, valid
from .tiles import on_tiles


def kernel(kind: str, sigma: float) -> list[float]:
    """Weights at -r..r. gauss: r = int(3 s); cubic: int(2 s); linear and mean: int(s)."""
    if kind == "gauss":
        r = int(3 * sigma)
        return [math.exp(-0.5 * (i / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)) for i in range(-r, r + 1)]
    if kind == "cubic":
        r = int(2 * sigma)
        value = lambda a: 2 / 3 - a * a + a**3 / 2 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0.0
        return [value(abs(i / sigma)) for i in range(-r, r + 1)]
    r = int(sigma)
    if kind == "linear":
        return [1 - abs(i) / r if r else 1.0 for i in range(-r, r + 1)]
    if kind == "mean":
        return [1.0] * (2 * r + 1)
    raise ValueError("kernels are gauss, cubic, linear and mean")


def _along(keys: list[str], axes: list[str], axis: str):
    """Window along one axis of each image."""
    return W.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)


def neighbour(column: str | Column, by: int, w) -> Column:
    """The value `by` places away along the window's axis; null where there is no voxel. Voxels are found by their place,
    so lines may have gaps."""
    return F.max(column).over(w.rangeBetween(by, by))


def _passes(x: np.ndarray, there: np.ndarray, weights: list[list[float]]) -> np.ndarray:
    """Weighted sums of tiles (tiles, *shape) along one axis after the other; places without a voxel hold nothing between
    the passes."""
    for axis, k in enumerate(weights, 1):
        if len(k) > 1 or k[0] != 1.0:
            r, out = len(k) // 2, np.zeros_like(x)
            for i, w in zip(range(-r, r + 1), k, strict=True):
                if w:
                    out += _moved(x, i, axis) * w
            x = out
        x = np.where(there, x, 0.0)
    return x


def _smoothed(a: DataFrame, keys: list[str], axes: list[str], columns: list[str], weights: list[list[float]], normal: bool) -> DataFrame:
    """a with the given columns convolved on tiles, all in one exchange. normal: divided by the convolved presence of
    their values; NaN stays. Otherwise the bare sums, NaN counting as 0."""

    def run(p, dense, origin, _, tile):
        *values, there = dense
        at, out, seen = (tile, *(p.astype(np.int64) - origin).T), [], {}
        for x in values:
            ok = ~np.isnan(x)
            sums = _passes(np.where(ok, x, 0.0), there, weights)[at]
            if normal:
                mark = ok.tobytes()
                if mark not in seen:
                    seen[mark] = _passes(ok.astype(float), there, weights)[at]
                d = seen[mark]
                sums = np.where(ok[at], np.divide(sums, d, out=np.zeros_like(sums), where=d != 0), np.nan)
            out.append(sums)
        return out

    far = max(len(k) // 2 for k in weights)
    keep = [c for c in a.columns if c not in columns]
    source = a.select(*keys, *axes, *[F.when(valid(c), F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in columns])
    got = on_tiles(a.select(keep), source, keys, axes, axes, (far, far), run, ", ".join(f"{c} double" for c in columns), keep, columns, many=True)
    return got.select(a.columns)


def convolve(a: DataFrame, keys: list[str], axes: list[str], sigmas: dict[str, float], kind: str = "gauss", spacing: dict[str, float] | None = None) -> DataFrame:
    """Normalised separable convolution: values and their presence are both convolved along each axis, and divided once
    at the end. NaN voxels count nowhere and stay NaN. A sigma above 0 is in mm (spacing), below 0 in voxels; 0: none."""
    return convolve_components(a, keys, axes, sigmas, ["value"], kind, spacing)


def convolve_components(field: DataFrame, keys: list[str], axes: list[str], sigmas: dict[str, float], components: list[str], kind: str = "gauss", spacing: dict[str, float] | None = None) -> DataFrame:
    """convolve() of each component of a vector field: a voxel gradient smoothed, or brought to the spacing of a grid's
    nodes with kind "cubic". Voxels and their surroundings meet on tiles (tiles.py), all components at once."""
    weights = []
    for axis in axes:
        s = sigmas.get(axis, 0.0)
        s = s / (spacing or {}).get(axis, 1.0) if s > 0 else -s
        weights.append(kernel(kind, s) if s else [1.0])
    return _smoothed(field, keys, axes, components, weights, normal=True)


def label_filter(a: DataFrame, keys: list[str], axes: list[str], variance: float) -> DataFrame:
    """Label with the largest Gaussian vote around each voxel, the least one on ties; variances in voxels.

    Voxels meet those around them on tiles (tiles.py); a tile's labels are smoothed one after the other. Voxels that no
    label reaches are left out.
    """
    r = int(3 * math.sqrt(variance))
    k = [math.exp(-0.5 * i * i / variance) / math.sqrt(2 * math.pi * variance) for i in range(-r, r + 1)]

    def kernel(p, dense, origin, rows):
        labels = dense[0]
        at = tuple((p.astype(np.int64) - origin).T)
        best, label = np.zeros(len(p)), np.zeros(len(p))
        for x in np.unique(labels[~np.isnan(labels)]):  # ascending, so that the least label keeps a tie
            vote = (labels == x).astype(float)
            for axis in range(len(axes)):
                vote = sum(w * _moved(vote, i, axis) for i, w in zip(range(-r, r + 1), k, strict=True))
            here = np.round(vote[at], 12)
            label = np.where(here > best, x, label)
            best = np.maximum(best, here)
        return [label[best > 0]], np.flatnonzero(best > 0)

    got = on_tiles(a.select(*keys, *axes), a, keys, axes, axes, (r, r), kernel, "value double", [*keys, *axes], ["value"])
    rest = [c for c in a.columns if c not in (*keys, *axes, "value")]
    return (a.select(*keys, *axes, *rest).join(got, [*keys, *axes]) if rest else got).select(a.columns)


def _moved(x: np.ndarray, by: int, axis: int) -> np.ndarray:
    """x moved by whole places along an axis, zeros moving in."""
    out = np.zeros_like(x)
    n = x.shape[axis]
    to, source = [slice(None)] * x.ndim, [slice(None)] * x.ndim
    to[axis], source[axis] = slice(max(0, -by), n - max(0, by)), slice(max(0, by), n - max(0, -by))
    out[tuple(to)] = x[tuple(source)]
    return out


def gradient(a: DataFrame, keys: list[str], axes: list[str], padding: float = 0.0) -> DataFrame:
    """g<axis>: half the difference of both neighbours, with padding beyond the edge; NaN becomes 0."""
    out = {}
    for x in axes:
        w = _along(keys, axes, x)
        g = (F.coalesce(neighbour("value", 1, w), F.lit(padding)) - F.coalesce(neighbour("value", -1, w), F.lit(padding))) / 2
        out[f"g{x}"] = F.coalesce(known(g), F.lit(0.0))
    return a.withColumns(out)


def shifted(keys: list[str], axes: list[str], move: dict[str, int], column: str = "value") -> Column:
    """The value `move` away along one axis (0 outside the image)."""
    ((axis, by),) = move.items()
    return F.coalesce(neighbour(column, by, _along(keys, axes, axis)), F.lit(0.0))


def shift(a: DataFrame, keys: list[str], axes: list[str], move: dict[str, int]) -> DataFrame:
    """The image moved by whole voxels: each voxel takes the value at its place plus move (0 outside)."""
    for x, by in move.items():
        if by:
            a = a.withColumn("value", shifted(keys, axes, {x: by}))
    return a


def local_mean(a: DataFrame, keys: list[str], voxel: list[str], reach: int, t: str = "t") -> DataFrame:
    """Mean over the time points from t - reach to t + reach that exist."""
    w = W.partitionBy(*keys, *voxel).orderBy(t).rowsBetween(-reach, reach)
    return a.withColumn("value", F.avg(known("value")).over(w))


def _descriptor(a: DataFrame, keys: list[str], axes: list[str], pairs: list[tuple[dict, dict]]) -> DataFrame:
    """d0..dn: exp(-D / mean of D) over the largest of them; D: squared difference of two shifted images, smoothed as by
    convolve(). NaN where a difference is undefined."""
    taken: dict[str, Column] = {}
    names = []
    for first, second in pairs:
        for m in (first, second):
            name = "_s" + "".join(f"{x}{m.get(x, 0)}" for x in axes).replace("-", "m")
            names.append(name)
            if name not in taken:
                taken[name] = shifted(keys, axes, m) if m else F.col("value")
    out = a.withColumns(taken)
    n = len(pairs)
    out = out.select(*keys, *axes, *[F.pow(F.col(names[2 * k]) - F.col(names[2 * k + 1]), F.lit(2.0)).alias(f"_d{k}") for k in range(n)])
    out = _smoothed(out, keys, axes, [f"_d{k}" for k in range(n)], [kernel("gauss", 0.5)] * len(axes), normal=True)
    d = [F.col(f"_d{k}") for k in range(n)]
    mean = reduce(lambda p, q: p + q, d) / n
    raw = out.withColumns({f"_e{k}": F.exp(-d[k] / F.when(mean == 0, F.lit(2.220446049250313e-16)).otherwise(mean)) for k in range(n)})
    most = F.greatest(*[F.col(f"_e{k}") for k in range(n)])
    return raw.select(*keys, *axes, *[(F.col(f"_e{k}") / most).alias(f"d{k}") for k in range(n)])


def mind(a: DataFrame, keys: list[str], axes: list[str], reach: int = 1) -> DataFrame:
    """Modality-independent descriptor: each voxel against its neighbours at +-reach along each axis."""
    return _descriptor(a, keys, axes, [({}, {x: s * reach}) for x in axes for s in (-1, 1)])


def mind_ssc(a: DataFrame, keys: list[str], axes: list[str], reach: int = 1) -> DataFrame:
    """Self-similarity context: neighbours along one axis against neighbours along another (four pairs an axis pair)."""
    sides = [(x, y) for i, x in enumerate(axes) for y in axes[i + 1 :]]
    return _descriptor(a, keys, axes, [({x: s * reach}, {y: t * reach}) for x, y in sides for s in (-1, 1) for t in (-1, 1)])


def lncc(pair: DataFrame, keys: list[str], axes: list[str], sigma: float = -5.0, kind: str = "gauss") -> DataFrame:
    """Mean absolute local correlation of value and w, local moments by convolution with sigma (below 0: voxels).

    Deviations under 1e-6 count as 0; terms that aren't finite don't count.
    """
    ok = valid("value") & valid("w")
    cols = {"_r": F.col("value"), "_f": F.col("w"), "_rr": F.col("value") * F.col("value"), "_ff": F.col("w") * F.col("w"), "_rf": F.col("value") * F.col("w"), "_n": F.lit(1.0)}
    out = pair.withColumns({n: F.when(ok, c).otherwise(F.lit(0.0)) for n, c in cols.items()}).withColumn("_ok", ok)
    out = _smoothed(out, keys, axes, list(cols), [kernel(kind, abs(sigma))] * len(axes), normal=False)
    # the voxel itself is defined here, so the weight isn't 0
    mean = out.where("_ok").select(*keys, *[(F.col(n) / F.col("_n")).alias(n) for n in cols if n != "_n"])
    dev = lambda a, b: F.sqrt(F.greatest(F.col(b) - F.col(a) * F.col(a), F.lit(0.0)))
    both = mean.select(*keys, (F.col("_rf") - F.col("_r") * F.col("_f")).alias("_c"), dev("_r", "_rr").alias("_sr"), dev("_f", "_ff").alias("_sf")).where("_sr >= 1e-6 AND _sf >= 1e-6")
    return both.groupBy(*keys).agg(F.avg(F.abs(F.col("_c") / (F.col("_sr") * F.col("_sf")))).alias("measure"))
