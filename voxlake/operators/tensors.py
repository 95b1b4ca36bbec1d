"""Tensor images read at any points: logarithms are interpolated, and the tensors turned as the transformation turns them.

Tensors are six columns d0..d5 (xx, xy, yy, xz, yz, zz). Logarithm, interpolation of all channels, exponential and turn
happen on tiles, in one exchange of the tensors and the points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import convert, tiles
from .resample import _weights
from .transform import PARTS

CHANNELS = [f"d{k}" for k in range(6)]
FULL = np.array([[0, 1, 3], [1, 2, 4], [3, 4, 5]])


def spectral(d: np.ndarray, fn) -> np.ndarray:
    """fn of the eigenvalues of tensors (n, 6); tensors with a NaN become NaN."""
    ok = np.isfinite(d).all(1)
    out = np.full(d.shape, np.nan)
    values, vectors = np.linalg.eigh(d[ok][:, FULL])
    out[ok] = _packed((vectors * fn(values)[:, None, :]) @ np.swapaxes(vectors, 1, 2))
    return out


def logarithms(d: np.ndarray) -> np.ndarray:
    """Eigenvalues not above 0 count as the least positive double."""
    return spectral(d, lambda v: np.log(np.maximum(v, np.finfo(float).tiny)))


def _packed(m: np.ndarray) -> np.ndarray:
    return m[:, [0, 1, 1, 2, 2, 2], [0, 0, 1, 0, 1, 2]]


def turned_back(d: np.ndarray, j: np.ndarray) -> np.ndarray:
    """R' D R for the orthogonal matrix R nearest to each Jacobian: the tensor as it is seen where the points come from."""
    ok = np.isfinite(d).all(1) & np.isfinite(j).all((1, 2))
    out = np.full(d.shape, np.nan)
    u, _, v = np.linalg.svd(j[ok])
    r = u @ v
    out[ok] = _packed(np.swapaxes(r, 1, 2) @ d[ok][:, FULL] @ r)
    return out


def resample_tensors(source: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str], order: int = 1, padding: float = 0.0, world: list[float] | None = None) -> DataFrame:
    """keys, point columns and d0..d5 of the tensor image at points p<axis>, turned by the points' Jacobian j<component><axis>.

    padding counts as each channel of the logarithm outside the source (0: the unit tensor); with NaN such points are NaN.
    world: voxel-to-world matrix (row-major, 4 by 4) where voxels aren't cubes along the tensors' axes; the Jacobian is then
    led into world axes. Axes that the image hasn't are left alone by the turn. A missing or undefined tensor among those
    that a point reads makes it NaN, as does an undefined Jacobian; null points are NaN. Orders as in resample.
    """
    weights, before, count = _weights(order)
    m = np.reshape(world, (4, 4))[:3, :3] if world is not None else np.eye(3)
    back = np.linalg.inv(m)
    parts = [(r, c, f"j{b}{a}") for r, b in enumerate("xyz") for c, a in enumerate("xyz") if a in axes and b in axes]

    def kernel(p, dense, origin, rows):
        *channels, there = dense
        held = np.full((*there.shape, 6), padding, float)
        held[there] = logarithms(np.stack([c[there] for c in channels], 1))
        out = np.zeros((len(p), 6))
        for at, k in tiles.taps(p, origin, [weights] * len(axes), before, count):
            v = held[at]
            out += np.where(k[:, None] == 0, 0.0, v * k[:, None]) if np.isfinite(padding) else v * k[:, None]
        out[np.isnan(p).any(1)] = np.nan
        j = np.tile(np.eye(3), (len(p), 1, 1))
        for r, c, name in parts:
            j[:, r, c] = rows[name].to_numpy()
        return list(turned_back(spectral(out, np.exp), m @ j @ back).T)

    at = [f"p{a}" for a in axes]
    asked = points.select(*dict.fromkeys([*keys, *point, *at, *[name for _, _, name in parts]]))
    out = ", ".join(f"{c} double" for c in CHANNELS)
    return tiles.on_tiles(asked, source, keys, axes, at, (before, count - before - 1), kernel, out, [*keys, *point], CHANNELS)


def transformed_tensors(t: convert.Transformation, source: DataFrame, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], order: int = 1, padding: float = 0.0, world: list[float] | None = None) -> DataFrame:
    """The tensor image at the places where a transformation of any kind leads the voxels, each turned by its Jacobian."""
    at = convert.deformation(t, voxels, keys, axes, dim).select(*keys, *axes, *[F.col(PARTS[a]).alias(f"p{a}") for a in axes])
    turn = convert.jacobian(t, voxels, keys, axes, dim).select(*keys, *axes, *[f"j{b}{a}" for b in axes for a in axes])
    return resample_tensors(source, at.join(turn, [*keys, *axes]), keys, axes, axes, order, padding, world)
