"""Ordered selections: best blocks, trimmed residuals, order statistics, best displacement and block matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import valid
from .measures import block_variance
from .order import order_statistics, ranks
from .tiles import on_tiles

#: Voxels of blocks at all displacements that are compared at once.
PLACES = 1 << 18

def top_blocks(a: DataFrame, keys: list[str], axes: list[str], percent: float, side: int = 4) -> DataFrame:
    """The given share of an image's usable blocks with the largest variance; place 1 is the largest, ties by position."""
    b = block_variance(a, keys, axes, side).where("usable")
    names = [f"b{x}" for x in axes]
    ranked = ranks(b.withColumn("_v", -F.col("variance")), keys, "_v", list(reversed(names)))
    return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * percent / 100)).withColumn("place", F.col("_rank").cast("int")).drop("_v", "_n", "_rank")


def trim(a: DataFrame, keys: list[str], order: list[str], percent: float) -> DataFrame:
    """The given share of rows with the least `residual`, ties by the order columns. NaN residuals don't count."""
    ranked = ranks(a, keys, "residual", order)
    return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * percent / 100)).drop("_rank", "_n")


def robust_range(a: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values at the sorted places round(n low) and round(n high)."""
    at = lambda q: lambda n: F.least(F.floor(n * q + 0.5), n - 1)
    return order_statistics(a, keys, "value", {"low": at(low), "high": at(high)})


def match_blocks(reference: DataFrame, warped: DataFrame, keys: list[str], axes: list[str], blocks: DataFrame, reach: int = 3, side: int = 4) -> DataFrame:
    """For each chosen block the displacement (d<axis>) with the largest absolute correlation in +-reach voxels.

    Chosen blocks of the reference meet the warped image on tiles (tiles.py), where many blocks are compared at once
    for all displacements. Ties go to the first displacement in raster order. Pairs of over half a block's voxels
    count.
    """
    names, shift, d = [f"b{x}" for x in axes], [f"d{x}" for x in axes], len(axes)
    at = reference.where(valid("value")).withColumns({n: F.floor(F.col(x) / side).cast("int") for n, x in zip(names, axes, strict=True)})
    rows = at.join(blocks.select(*keys, *names), [*keys, *names], "left_semi").select(*keys, *names, *axes, F.col("value").alias("_r"))
    n_side = {1: 256, 2: 16, 3: 16}[d] // side * side

    def kernel(p, dense, origin, column, tile):
        warped, there = dense
        here = p.astype(np.int64) - origin - reach
        spot = here // side
        each = (n_side // side,) * d
        block, of = np.unique(np.ravel_multi_index((tile, *spot.T), (len(there), *each)), return_inverse=True)
        first = np.zeros(len(block), np.int64)
        first[of] = np.arange(len(p))
        ref = np.full((len(block), *(side,) * d), np.nan)
        ref[(of, *(here - spot * side).T)] = column("_r")
        corner = (tile[first], *(spot[first] * side).T)
        around = np.lib.stride_tricks.sliding_window_view(warped, (side + 2 * reach,) * d, tuple(range(1, d + 1)))
        best, move = np.empty(len(block)), np.empty((d, len(block)), np.int32)
        few = max(1, PLACES // ((2 * reach + 1) * side) ** d)
        for lo in range(0, len(block), few):
            at = slice(lo, lo + few)
            best[at], move[:, at] = _best_moves(ref[at], around[tuple(c[at] for c in corner)], reach)
        use = np.flatnonzero(best >= 0)
        return [best[use], *move[:, use]], first[use]

    out = "ncc double, " + ", ".join(f"{s} int" for s in shift)
    return on_tiles(rows, warped.where(valid("value")), keys, axes, axes, (reach, reach), kernel, out, [*keys, *names], ["value"], n_side, many=True)


def _best_moves(ref: np.ndarray, around: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest absolute correlation of each block with what lies around it (-1 if none counts), and where."""
    d, side = ref.ndim - 1, ref.shape[1]
    lead, within = tuple(range(1, d + 1)), tuple(range(-d, 0))
    # raster order: the first axis runs fastest
    w = np.lib.stride_tricks.sliding_window_view(around, (side,) * d, lead).transpose(0, *lead[::-1], *range(d + 1, 2 * d + 1))
    sums = lambda x: x.sum(within)
    wide = lambda x: x[(..., *(None,) * d)]
    ok = ~np.isnan(ref)
    r0 = np.where(ok, ref - wide(sums(np.where(ok, ref, 0.0)) / np.maximum(sums(ok), 1)), 0.0)
    ok, r0 = (x[(slice(None), *(None,) * d)] for x in (ok, r0))
    both = ok & ~np.isnan(w)
    n = sums(both)
    many = np.maximum(n, 1)
    w = np.where(both, w, 0.0)
    w0 = np.where(both, w - wide(sums(w) / many), 0.0)
    r = np.where(both, r0, 0.0)
    cov, vr, vw = sums(r * w0), sums(r * r) - sums(r) ** 2 / many, sums(w0 * w0)
    good = (n > side**d // 2) & (vr > 1e-300) & (vw > 1e-300)
    ncc = np.where(good, np.round(np.abs(cov) / np.sqrt(np.where(good, vr * vw, 1.0)), 9), -1.0).reshape(len(ref), -1)
    place = ncc.argmax(1)
    moves = np.unravel_index(place, (2 * reach + 1,) * d)[::-1]
    return ncc[np.arange(len(ref)), place], np.stack(moves) - reach
