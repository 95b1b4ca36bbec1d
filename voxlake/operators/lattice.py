"""Control lattices on tiles: values and slopes of spline sums at any points, in one exchange of nodes and points.

A tile holds a part of the lattice with the border of nodes that its points reach. Where the points of a tile lie on a
grid, as the voxels of an image do, the sums are taken along one axis after the other, for many tiles at once; elsewhere
the nodes around each point are weighed one offset after the other. No row is made for a point and a node.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import B_SPLINE, B_SPLINE_D, LINEAR, LINEAR_D
from . import tiles

#: Weights, their slopes, and the nodes before the one at or below a point.
KINDS = {"cubic": (B_SPLINE, B_SPLINE_D, 1), "linear": (LINEAR, LINEAR_D, 0)}
#: Nodes along an axis of a tile, in one, two and three dimensions: a node stands for many voxels.
SIDES = {1: 256, 2: 16, 3: 8}
#: Points of a tile, on the average, from which tiles are worked on one by one.
MANY = 1 << 13


def _basis(table: list, f: np.ndarray) -> np.ndarray:
    return np.stack([np.polyval(c, f) * np.ones_like(f) for c in table])


def _products(p: np.ndarray, arrays: list[list[np.ndarray]], origin: np.ndarray, tables: list[list], before: int, tile: np.ndarray) -> list[np.ndarray] | None:
    """For each table list (one for each axis) and its dense arrays (tiles, *shape), the sums at the points, if these lie on
    one grid in all tiles."""
    if not np.isfinite(p).all():
        return None
    q = p - origin
    places, ticks = zip(*(pd.factorize(q[:, k]) for k in range(p.shape[1])), strict=True)
    if len(arrays[0][0]) * np.prod([len(t) for t in ticks]) > 2 * len(p):
        return None
    out, lows = [], [np.floor(t) for t in ticks]
    for table, dense in zip(tables, arrays, strict=True):
        weights = [_basis(table[k], t - low) for k, (t, low) in enumerate(zip(ticks, lows, strict=True))]
        for x in dense:
            for k, low in enumerate(lows, 1):
                at = low.astype(np.int64) - before
                wide = (-1, *(1,) * (x.ndim - k - 1))
                # tap by tap: a tile's sums don't depend on the tiles beside it
                x = sum(w.reshape(wide) * np.take(x, at + i, k) for i, w in enumerate(weights[k - 1]))
            out.append(x[(tile, *places)])
    return out


def _gathered(p: np.ndarray, arrays: list[list[np.ndarray]], origin: np.ndarray, tables: list[list], before: int, tile: np.ndarray) -> list[np.ndarray]:
    out = []
    for table, dense in zip(tables, arrays, strict=True):
        sums = [np.zeros(len(p)) for _ in dense]
        weights = [lambda f, c=c: _basis(c, f) for c in table]
        for at, k in tiles.taps(p, origin, weights, before, len(table[0]), tile):
            for s, x in zip(sums, dense, strict=True):
                s += x[at] * k
        out += sums
    return out


def _sums(p: np.ndarray, arrays: list[list[np.ndarray]], origin: np.ndarray, tables: list[list], before: int, tile: np.ndarray) -> list[np.ndarray]:
    """Sums at the points of all tiles; tiles of many points, which may each lie on a grid of their own, one by one."""
    args = (tables, before)
    found = _products(p, arrays, origin, *args, tile)
    if found is not None:
        return found
    n = len(arrays[0][0])
    if n == 1 or len(p) < MANY * n:
        return _gathered(p, arrays, origin, *args, tile)
    parts = []
    for k, at in enumerate(np.split(np.arange(len(p)), np.flatnonzero(np.diff(tile)) + 1)):
        parts.append(_sums(p[at], [[x[k : k + 1] for x in dense] for dense in arrays], origin[at], *args, np.zeros(len(at), np.int64)))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def lattice_sums(points: DataFrame, nodes: DataFrame, keys: list[str], point: list[str], axes: list[str], wanted: list[tuple[str | None, dict[str, str]]], kind: str = "cubic", whole: bool = False, coordinates: list[str] | None = None) -> DataFrame:
    """Sums of node components at lattice coordinates q<axis> (or those named), with the columns `keys` and `point`.

    wanted: (axis of the slope or None for the value, {component: output column}) for each kind of sum. Nodes that don't
    exist add nothing; points that no node reaches are left out, with whole those that lack any. Repeated points stay.
    """
    values, slopes, before = KINDS[kind]
    count, d = len(values), len(axes)
    components = list(dict.fromkeys(c for _, names in wanted for c in names))
    tables = [[slopes if a == by else values for a in axes] for by, _ in wanted]
    ones = [[(1.0,)] * count] * d  # how many nodes are there
    names = [n for _, some in wanted for n in some.values()]

    def kernel(p, dense, origin, _, tile):
        *held, there = dense
        held = dict(zip(components, (np.where(there, x, 0.0) for x in held), strict=True))
        arrays = [[there.astype(float)], *([held[c] for c in some] for _, some in wanted)]
        found = _sums(p, arrays, origin, [ones, *tables], before, tile)
        use = np.flatnonzero(np.round(found[0]) >= (count**d if whole else 1))
        return [x[use] for x in found[1:]], use

    at = coordinates or [f"q{a}" for a in axes]
    asked = points.select(*dict.fromkeys([*keys, *point, *at]))
    out = ", ".join(f"{n} double" for n in names)
    return tiles.on_tiles(asked, nodes, keys, axes, at, (before, count - before - 1), kernel, out, [*keys, *point], components, SIDES[d], many=True)


def voxel_sums(nodes: DataFrame, voxels: DataFrame, keys: list[str], axes: list[str], spacing: float, wanted: dict[str, list[tuple[str, str | None]]], kind: str = "cubic") -> DataFrame:
    """What voxels leave at the nodes that reach them, the transpose of lattice_sums(): the nodes with all their columns and
    one more for each of `wanted`.

    wanted: for each output the voxel columns that are summed, with the axis of the slope that weighs them or None for the
    value. Nodes are `spacing` voxels apart. A node meets the voxels in its reach on a tile of voxels, where the sums are
    products of one basis matrix an axis. Nodes that no voxel reaches get 0; null and NaN add nothing.
    """
    values, slopes, before = KINDS[kind]
    count, d, spacing = len(values), len(axes), float(spacing)
    reach = math.ceil(count / 2 * spacing)
    columns = list(dict.fromkeys(c for terms in wanted.values() for c, _ in terms))

    def kernel(p, dense, origin, _):
        held = {c: np.nan_to_num(x, nan=0.0) for c, x in zip(columns, dense, strict=False)}
        ticks, places = zip(*(np.unique(np.round(p[:, k] / spacing).astype(np.int64) + 1, return_inverse=True) for k in range(d)), strict=True)
        basis = {}
        for k, t in enumerate(ticks):
            q = (np.arange(dense[0].shape[k]) + origin[k]) / spacing + 1
            low = np.floor(q)
            tap = t[:, None] - low.astype(np.int64) + before  # which weight of a voxel is the node's
            for name, table in (("value", values), ("slope", slopes)):
                w = _basis(table, q - low)
                basis[k, name] = np.where((tap >= 0) & (tap < count), np.take_along_axis(w, np.clip(tap, 0, count - 1), 0), 0.0)
        out = []
        for terms in wanted.values():
            total = np.zeros(len(p))
            for c, by in terms:
                x = held[c]
                for k, a in enumerate(axes):
                    x = np.moveaxis(np.tensordot(basis[k, "slope" if a == by else "value"], x, (1, k)), 0, k)
                total += x[places] / (spacing if by else 1.0)
            out.append(total)
        return out

    at = [f"_v{a}" for a in axes]
    asked = nodes.withColumns({c: (F.col(a) - 1) * spacing for c, a in zip(at, axes, strict=True)})
    out = ", ".join(f"{c} double" for c in wanted)
    return tiles.on_tiles(asked, voxels, keys, axes, at, (reach, reach), kernel, out, nodes.columns, columns, max(tiles.SIDES[d], reach))
