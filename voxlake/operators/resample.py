"""Interpolation: an image read at arbitrary points.

Points carry key columns, an id of their own (any columns) and voxel coordinates px, py (and pz) in the source image.
Points and the voxels around them meet on tiles with a halo, where the taps are added up in arrays: one exchange of
either, and no row for a tap. Taps outside the source count as the padding value.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CATMULL_ROM, CATMULL_ROM_D, LINEAR, LINEAR_D, clamp
from . import tiles

#: Full width at half maximum of a Gaussian, in sigmas.
FULL_WIDTH = 2 * np.sqrt(2 * np.log(2))
#: Samples that a kernel holds at once.
SAMPLES = 1 << 18


def _weights(order: int, derivative: bool = False):
    """Function of fractions (n,) that gives the taps' weights (taps, n), taps before floor(p), and their number."""
    if order == 0:
        return lambda f: np.stack([f < 0.5, f >= 0.5]).astype(float), 0, 2
    if order in (1, 3):
        table = {(1, False): LINEAR, (1, True): LINEAR_D, (3, False): CATMULL_ROM, (3, True): CATMULL_ROM_D}[order, derivative]
        return lambda f: np.stack([np.polyval(c, f) * np.ones_like(f) for c in table]), order // 2, order + 1
    if order == 4 and not derivative:

        def sinc(f: np.ndarray) -> np.ndarray:
            x = f - np.arange(-2, 4)[:, None]
            w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
            return w / w.sum(0)

        return sinc, 2, 6
    raise ValueError("interpolation orders are 0, 1, 3 and (values only) 4")


def resample(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], order: int = 1, padding: float = 0.0, derivative: str | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """keys, point columns, value. derivative names an axis along which the weights' slope is used instead.

    A padding of NaN makes every point NaN that misses a tap, also one of weight 0. limits: the element type's range.
    Points and the parts of the source around them meet on tiles (tiles.py), in one exchange of each.
    """
    each = [_weights(order, derivative == a) for a in axes]
    _, before, count = each[0]

    def kernel(p, dense, origin, _, tile):
        values, there = dense
        values = np.where(there, values, padding)
        out = np.zeros(len(p))
        for at, k in tiles.taps(p, origin, [w for w, _, _ in each], before, count, tile):
            out += values[at] * k
        return [out]

    at = [f"p{a}" for a in axes]
    got = tiles.on_tiles(points.select(*keys, *point, *at), source, keys, axes, at, (before, count - before - 1), kernel, "value double", [*keys, *point], ["value"], many=True)
    return got.withColumn("value", clamp(F.col("value"), *limits)) if limits else got


def resample_components(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], columns: list[str], order: int = 1, padding: float = 0.0) -> DataFrame:
    """keys, point columns and the given columns of the source at points p<axis>: all of them in the one exchange."""
    weights, before, count = _weights(order)

    def kernel(p, dense, origin, _, tile):
        *values, there = dense
        values = [np.where(there, v, padding) for v in values]
        out = [np.zeros(len(p)) for _ in values]
        for at, k in tiles.taps(p, origin, [weights] * len(axes), before, count, tile):
            for x, v in zip(out, values, strict=True):
                x += v[at] * k
        return out

    at = [f"p{a}" for a in axes]
    asked = points.select(*dict.fromkeys([*keys, *point, *at]))
    return tiles.on_tiles(asked, source, keys, axes, at, (before, count - before - 1), kernel, ", ".join(f"{c} double" for c in columns), [*keys, *point], columns, many=True)


def value_and_gradient(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], order: int = 1, padding: float = float("nan")) -> DataFrame:
    """keys, point columns, w (the source's value at p<axis>) and s<axis> (its slopes), all on the same tiles."""
    kinds = [None, *axes]
    each = [[_weights(order, by == a)[0] for a in axes] for by in kinds]
    _, before, count = _weights(order)

    def kernel(p, dense, origin, _, tile):
        values, there = dense
        values = np.where(there, values, padding)
        out = []
        for weights in each:
            x = np.zeros(len(p))
            for at, k in tiles.taps(p, origin, weights, before, count, tile):
                x += values[at] * k
            out.append(x)
        return out

    at = [f"p{a}" for a in axes]
    asked = points.select(*dict.fromkeys([*keys, *point, *at]))
    return tiles.on_tiles(asked, source, keys, axes, at, (before, count - before - 1), kernel, ", ".join(["w double", *[f"s{a} double" for a in axes]]), [*keys, *point], ["value"], many=True)


def image_gradient(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], order: int = 1, padding: float = 0.0) -> DataFrame:
    """g<axis>: slope of the interpolated source at each point along each axis; not defined: 0."""
    value, before, count = _weights(order)
    slope = _weights(order, True)[0]

    def kernel(p, dense, origin, _, tile):
        values, there = dense
        values = np.where(there, values, padding)
        out = []
        for k in range(len(axes)):
            g = np.zeros(len(p))
            for at, w in tiles.taps(p, origin, [slope if j == k else value for j in range(len(axes))], before, count, tile):
                g += values[at] * w
            out.append(np.where(np.isnan(g), 0.0, g))
        return out

    at = [f"p{a}" for a in axes]
    return tiles.on_tiles(points.select(*keys, *point, *at), source, keys, axes, at, (before, count - before - 1), kernel, ", ".join(f"g{a} double" for a in axes), [*keys, *point], ["value"], many=True)


def downsample(a: DataFrame, axes: list[str]) -> DataFrame:
    """Every second voxel along the axes; the caller smooths before (sigma 0.7355 voxels) where that is wanted."""
    for x in axes:
        a = a.where(F.col(x) % 2 == 0).withColumn(x, (F.col(x) / 2).cast("int"))
    return a


def mask_pyramid(mask: DataFrame, dim: dict[str, int], levels: int, least: int = 32) -> list[DataFrame]:
    """Masks from the coarsest to the finest level, halved along the axes that pyramid() halves, without smoothing."""
    out, size = [mask], dim
    for _ in range(levels - 1):
        halve = [x for x, n in size.items() if n // 2 >= least]
        out.insert(0, downsample(out[0], halve))
        size = {x: -(-n // 2) if x in halve else n for x, n in size.items()}
    return out


def change_resolution(source: DataFrame, targets: DataFrame, keys: list[str], axes: list[str], factor: dict[str, float], shift: dict[str, float], order: int = 1) -> DataFrame:
    """An image on a grid whose voxels are `factor` old ones apart. Axes that become coarser are seen through a point
    spread of the missing width (full width at half maximum), unless the nearest voxel is wanted."""
    points = new_grid_points(targets, axes, factor, shift)
    if order == 0 or all(factor[a] <= 1 for a in axes):
        return resample(source, points, keys, axes, axes, order)
    sigma = {a: np.sqrt(max(0.0, factor[a] ** 2 - 1.0)) / FULL_WIDTH for a in axes}
    return psf_resample(source, points, keys, axes, axes, sigma)


def pyramid(a: DataFrame, keys: list[str], dim: dict[str, int], levels: int, smooth: bool = True, least: int = 32) -> list[tuple[DataFrame, dict[str, int]]]:
    """Images from the coarsest to the finest level; an axis is halved only while half of it has `least` voxels."""
    from .stencil import convolve

    out = [(a, dim)]
    for _ in range(levels - 1):
        now, size = out[0]
        halve = [x for x, n in size.items() if n // 2 >= least]
        if smooth and halve:
            now = convolve(now, keys, list(size), {x: -0.7355 for x in halve})
        out.insert(0, (downsample(now, halve), {x: -(-n // 2) if x in halve else n for x, n in size.items()}))
    return out


def new_grid_points(targets: DataFrame, axes: list[str], factor: dict[str, float], shift: dict[str, float]) -> DataFrame:
    """p<axis> = x * factor + shift: positions of a regridded image's voxels in the old one."""
    return targets.withColumns({f"p{a}": F.col(a) * float(factor[a]) + float(shift[a]) for a in axes})


def isotropic(spacing: list[float], dim: list[int]) -> tuple[float, list[int], list[float], list[float]]:
    """Finest spacing for all axes: new spacing, dimensions, and each axis's factor and shift into the old voxels."""
    s = min(spacing)
    return s, [-(-int(round(n * p * 1e6)) // int(round(s * 1e6))) for n, p in zip(dim, spacing, strict=True)], [s / p for p in spacing], [s / (2 * p) - 0.5 for p in spacing]


def psf_resample(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], sigma: dict[str, float], padding: float = float("nan")) -> DataFrame:
    """Values seen through a Gaussian point spread: each point is the weighted mean of linear samples on a grid of
    half-sigma steps out to two sigmas. Samples outside the source don't count; a point without any gets the padding."""
    linear, _, _ = _weights(1)
    steps = [[(i / 2 * float(sigma[a]), np.exp(-0.5 * i * i / 4)) for i in range(-4, 5)] if sigma[a] > 0 else [(0.0, 1.0)] for a in axes]
    moves = np.array([[x for x, _ in m] for m in product(*steps)])
    gains = np.array([np.prod([w for _, w in m]) for m in product(*steps)])
    reach = int(np.ceil(2 * max(sigma[a] for a in axes))) + 1

    def kernel(p, dense, origin, _):
        values, there = dense
        there = there & ~np.isnan(values)
        values = np.where(there, values, 0.0)
        total, seen = np.zeros(len(p)), np.zeros(len(p))
        some = max(1, SAMPLES // max(1, len(p)))  # samples of each point that are read at once
        for lo in range(0, len(moves), some):
            part, g = moves[lo : lo + some], gains[lo : lo + some]
            q = (p[:, None, :] + part).reshape(-1, len(axes))
            for at, k in tiles.taps(q, origin, [linear] * len(axes), 0, 2):
                k = k.reshape(-1, len(part)) * g
                total += (values[at].reshape(k.shape) * k).sum(1)
                seen += (there[at].reshape(k.shape) * k).sum(1)
        return [np.where(seen > 0, total / np.where(seen > 0, seen, 1.0), padding)]

    at = [f"p{a}" for a in axes]
    return tiles.on_tiles(points.select(*keys, *point, *at), source, keys, axes, at, (reach, reach + 1), kernel, "value double", [*keys, *point], ["value"])


def spread_of(j: np.ndarray, target: list[float], source: list[float], algorithm: str = "matrix") -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n, d) and eigenvectors (n, d, d) of the point spread between a grid and an image with variances
    `target` and `source` along their axes, whose Jacobians are j (n, d, d).

    The image's spread is brought into the grid's space. "matrix": what the grid's has beyond it, no eigenvalue below 0.
    "determinant": the least spread that covers both, found where the image's is round.
    """
    t, a = np.diag(target), np.linalg.inv(j)
    s = a @ np.diag(source) @ np.swapaxes(a, 1, 2)
    if algorithm == "matrix":
        vals, vecs = np.linalg.eigh(t - s)
        return np.maximum(vals, 1e-6), vecs
    if algorithm != "determinant":
        raise ValueError("algorithms are matrix and determinant")
    ds, zs = np.linalg.eigh(s)
    volume = np.prod(ds, 1) ** 0.25
    scale = volume[:, None] / np.sqrt(ds)
    round_ = scale[:, :, None] * (np.swapaxes(zs, 1, 2) @ t @ zs) * scale[:, None, :]
    dt, zt = np.linalg.eigh(round_)
    full = (zt * np.maximum(np.sqrt(volume)[:, None], dt)[:, None, :]) @ np.swapaxes(zt, 1, 2)
    q = zs @ (full / (scale[:, :, None] * scale[:, None, :])) @ np.swapaxes(zs, 1, 2)
    vals, vecs = np.linalg.eigh(q - s)
    return np.maximum(vals, 0.0), vecs


def _spread_out(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], moves, longest: float, order: int, padding: float) -> DataFrame:
    """Each point as the weighted mean of samples around it. moves(j) gives (n, samples, d) offsets in the grid's space and
    their weights; the point's Jacobian j<component><axis> leads them into the image. A tap beyond the image counts 0, a
    sample without any doesn't count."""
    names = [f"j{b}{a}" for b in axes for a in axes]
    most = points.agg(*[F.max(sum((F.abs(F.col(f"j{b}{a}")) for a in axes), F.lit(0.0))) for b in axes]).first()
    weigh, before, count = _weights(order)
    reach = int(np.ceil(longest * max([x for x in most if x is not None] or [0.0]))) + 3

    def kernel(p, dense, origin, rows):
        values, there = dense
        there = there & ~np.isnan(values)
        values = np.where(there, values, 0.0)
        out = np.full(len(p), padding)
        jac = np.stack([rows[c].to_numpy().astype(float) for c in names], 1).reshape(-1, len(axes), len(axes))
        few = max(1, SAMPLES // 512)
        for lo in range(0, len(p), few):
            j = jac[lo : lo + few]
            offset, weight = moves(j)
            q = p[lo : lo + few, None, :] + np.einsum("nba,nma->nmb", j, offset)
            total, seen = np.zeros(weight.size), np.zeros(weight.size, bool)
            for at, k in tiles.taps(q.reshape(-1, len(axes)), origin, [weigh] * len(axes), before, count):
                total += values[at] * k
                seen |= there[at]
            weight = weight * seen.reshape(weight.shape)
            all_ = weight.sum(1)
            out[lo : lo + few] = np.where(all_ != 0, (total.reshape(weight.shape) * weight).sum(1) / np.where(all_ != 0, all_, 1.0), padding)
        return [out]

    at = [f"p{a}" for a in axes]
    return tiles.on_tiles(points.select(*keys, *point, *at, *names), source, keys, axes, at, (reach + before, reach + count - before), kernel, "value double", [*keys, *point], ["value"])


def psf_resample_between(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], target: dict[str, float], image: dict[str, float], algorithm: str = "matrix", order: int = 1, padding: float = float("nan")) -> DataFrame:
    """Values seen through the point spread that leads from the image's resolution to the grid's, with each point's own
    covariance from its Jacobian j<component><axis>. target, image: variances along the axes. Samples stand three
    quarters of a deviation apart along the spread's axes, out to three of them, none along axes that hardly spread."""
    grid = np.array(list(product([0.75 * i for i in range(-3, 4)], repeat=len(axes))))
    grid = grid[(grid**2).sum(1) <= 9.0]

    def moves(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vals, vecs = spread_of(j, [target[a] for a in axes], [image[a] for a in axes], algorithm)
        flat = vals < 0.01
        weight = np.exp(-0.5 * (grid**2).sum(1))[None, :] * ~((grid[None] != 0) & flat[:, None, :]).any(2)
        return np.einsum("nba,nma->nmb", vecs, grid[None] * np.sqrt(vals)[:, None, :]), weight

    return _spread_out(source, points, keys, axes, point, moves, 3 * np.sqrt(max(target.values())) * (1 if algorithm == "matrix" else 4), order, padding)


def psf_resample_sinc(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], order: int = 1, padding: float = float("nan")) -> DataFrame:
    """Values seen through the positive part of a windowed sinc of the grid's own resolution: samples 0.3 voxels apart out
    to three voxels, led into the image by each point's Jacobian j<component><axis>."""
    steps = np.array([-3 + 0.3 * i for i in range(21)])
    taps = np.sinc(steps) * np.sinc(steps / 3)
    grid, gain = np.array(list(product(steps, repeat=len(axes)))), np.array([np.prod(w) for w in product(taps, repeat=len(axes))])
    grid, gain = grid[gain > 0], gain[gain > 0]
    return _spread_out(source, points, keys, axes, point, lambda j: (np.broadcast_to(grid, (len(j), *grid.shape)), np.broadcast_to(gain, (len(j), len(gain)))), 3.0, order, padding)
