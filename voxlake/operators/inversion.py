"""Inverses of dense fields on tiles: a fixed point where that converges, else steps by the field's slopes, else a simplex
search, for all voxels of a tile at once.

Voxels and the field around them meet once; the whole search of a voxel runs inside its tile and halo. Only voxels whose
search ends at the border of the halo are dealt anew, by where they have come to, so the number of exchanges follows how
far the field moves and not the steps of the search.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .lineage import cut
from .transform import PARTS, parts_of


def simplex(cost: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, step: np.ndarray, enough: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Nelder and Mead's downhill search for many points side by side: the best places (n, d) and their costs.

    cost(which, places) gives the costs of the points `which` at these places. A point rests once its cost is at most
    `enough` or its simplex has no extent left.
    """
    n, d = start.shape
    corners = np.repeat(start[:, None], d + 1, 1)
    corners[:, 1:] += step[:, None, None] * np.eye(d)
    everyone = np.arange(n)
    values = np.stack([cost(everyone, corners[:, k]) for k in range(d + 1)], 1)
    live = everyone
    for _ in range(rounds):
        c, v = corners[live], values[live]
        by = np.argsort(v, 1, kind="stable")
        c, v = np.take_along_axis(c, by[..., None], 1), np.take_along_axis(v, by, 1)
        corners[live], values[live] = c, v
        go = (v[:, 0] > enough) & (np.abs(c[:, 1:] - c[:, :1]).max((1, 2)) > 1e-13)
        live, c, v = live[go], c[go], v[go]
        if not len(live):
            break
        middle, last = c[:, :-1].mean(1), c[:, -1]
        mirrored = 2 * middle - last
        at_mirror = cost(live, mirrored)
        best, fair = at_mirror < v[:, 0], at_mirror < v[:, -2]
        # farther on after a new best place, else nearer to the middle, on the better side
        reach = np.where(best, 2.0, np.where(at_mirror < v[:, -1], 0.5, -0.5))[:, None]
        tried = middle + reach * (middle - last)
        at_tried = cost(live, tried)
        use_tried = np.where(fair, best & (at_tried < at_mirror), at_tried < np.minimum(at_mirror, v[:, -1]))
        moved = use_tried | fair
        corners[live[moved], -1] = np.where(use_tried[:, None], tried, mirrored)[moved]
        values[live[moved], -1] = np.where(use_tried, at_tried, at_mirror)[moved]
        small = live[~moved]
        for k in range(1, d + 1 if len(small) else 1):
            corners[small, k] = (corners[small, 0] + corners[small, k]) / 2
            values[small, k] = cost(small, corners[small, k])
    first = values.argmin(1)
    return corners[everyone, first], values[everyone, first]


def _reader(dense: list[np.ndarray], origin: np.ndarray, last: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The field at places (n, d), linear between voxels, its edge value moving on with places beyond the image; NaN where
    the tile and its halo don't reach or a voxel is missing."""
    shape = np.array(dense[0].shape)

    def read(y: np.ndarray) -> np.ndarray:
        inside = np.clip(y, 0, last)
        low = np.minimum(np.floor(inside), np.maximum(last - 1, 0))
        f, at = inside - low, low.astype(np.int64) - origin
        held = ((at >= 0) & (at < shape - 1)).all(1) & np.isfinite(y).all(1)
        at = np.clip(np.where(held[:, None], at, 0), 0, shape - 2)
        out = y - inside
        for step in product((0, 1), repeat=len(shape)):
            w = np.prod(np.where(step, f, 1 - f), 1)
            place = tuple((at + step).T)
            out = out + np.stack([np.where(w == 0, 0.0, x[place] * w) for x in dense], 1)
        return np.where(held[:, None], out, np.nan)

    return read


def _squares(x: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)
    return np.where(np.isnan(d), np.inf, d)


def _newton(read: Callable, target: np.ndarray, best: np.ndarray, least: np.ndarray, live: np.ndarray, rounds: int = 30) -> None:
    """Steps by the slopes of the cell that each place lies in, halved up to three times, as long as they come closer."""
    h = 0.25
    for _ in range(rounds):
        if not len(live):
            break
        y = best[live]
        miss = read(y) - target[live]
        ahead = np.where(y - np.floor(y) < 0.5, h, -h)  # within the cell, where the field is linear along each axis
        slopes = np.stack([(read(y + ahead * e) - target[live] - miss) / ahead[:, k, None] for k, e in enumerate(np.eye(y.shape[1]))], 2)
        good = np.isfinite(slopes).all((1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(slopes))) > 1e-9)
        live, y, miss = live[good], y[good], miss[good]
        step = np.linalg.solve(slopes[good], miss[..., None])[..., 0]
        moved = np.zeros(len(live), bool)
        for part in (1.0, 0.5, 0.25, 0.125):
            left = np.flatnonzero(~moved)
            if not len(left):
                break
            place = y[left] - part * step[left]
            now = _squares(read(place) - target[live[left]])
            closer = now < least[live[left]]
            at = live[left[closer]]
            best[at], least[at], moved[left[closer]] = place[closer], now[closer], True
        live = live[moved]


def _searched(read: Callable, target: np.ndarray, start: np.ndarray, fixed: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    enough = tolerance**2
    best, y, miss = start.copy(), start.copy(), read(start) - target
    least = _squares(miss)
    far = lambda: np.flatnonzero((least > enough) & np.isfinite(least))
    live = far()
    for _ in range(fixed):
        if not len(live):
            break
        y[live] -= miss[live]
        miss[live] = read(y[live]) - target[live]
        now = _squares(miss[live])
        closer = now < least[live]
        best[live[closer]], least[live[closer]] = y[live[closer]], now[closer]
        live = live[(now > enough) & np.isfinite(now)]
    _newton(read, target, best, least, far())
    for _ in range(4):  # a simplex that has fallen flat starts again from its best place
        left = far()
        if not len(left):
            break
        best[left], least[left] = simplex(lambda which, y, left=left: _squares(read(y) - target[left[which]]), best[left], 1.5 * np.sqrt(least[left]), enough)
        _newton(read, target, best, least, left)
    return best, np.sqrt(least)


def inverse_field(field: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], rounds: int = 20, tolerance: float = 1e-6, halo: int = 8, passes: int = 10) -> DataFrame:
    """vx, vy (and vz) of the inverse at each voxel of the field, and `residual`: how far the field leads from the voxel there.

    At most `rounds` fixed point steps come first, from the voxel itself, then, where the residual is above the tolerance,
    steps by the slopes and at last the simplex search. A voxel whose residual no longer halves in a pass keeps its best place. Beyond the image's edge
    the edge value moves on with the point. Missing or undefined voxels of the field can't be searched: a voxel beside
    them stays at its place with an infinite residual. An empty field gives no rows; voxels must not repeat.
    """
    size, last = len(axes), np.array([float(dim[a] - 1) for a in axes])
    goal, now = [f"_at{a}" for a in axes], [f"_y{a}" for a in axes]
    state = [*parts_of(axes), "residual", "_rest"]

    def once(points: DataFrame, fixed: int) -> DataFrame:
        def kernel(_, dense, origin, rows):
            target, start = (np.stack([rows[c].to_numpy() for c in some], 1).astype(float) for some in (axes, now))
            before = rows["_left"].to_numpy()
            best, left = _searched(_reader(dense[:-1], origin, last), target, start, fixed, tolerance)
            return [*best.T, left, ((left <= tolerance) | ~(left < before / 2)).astype(float)]

        inside = points.withColumns({g: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(dim[a] - 1))) for g, c, a in zip(goal, now, axes, strict=True)})
        return tiles.on_tiles(inside, field, keys, axes, goal, (halo, halo + 1), kernel, ", ".join(f"{c} double" for c in state), [*keys, *axes], parts_of(axes))

    first = field.select(*keys, *axes, *[F.col(a).cast("double").alias(c) for a, c in zip(axes, now, strict=True)], F.lit(float("inf")).alias("_left"))
    out = cut(once(first, rounds))
    for _ in range(passes):
        again = out.where("_rest = 0").select(*keys, *axes, *[F.col(PARTS[a]).alias(c) for a, c in zip(axes, now, strict=True)], F.col("residual").alias("_left"))
        if again.isEmpty():
            break
        out = cut(out.where("_rest = 1").unionByName(once(again, 0)))
    return out.select(*keys, *axes, *state[: size + 1])
