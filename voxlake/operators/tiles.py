"""Tiles with a halo: points or voxels meet the part of an image around them in one exchange, as dense arrays.

An image is cut into tiles of `side` voxels along each axis. A voxel is sent to its own tile and to those whose halo
holds it; a point is sent to the tile that it lies in. A task works on one tile at a time, so its memory depends on the
tile and its halo alone, whatever the size of the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Voxels along an axis of a tile, in two and in three dimensions.
SIDES = {1: 1024, 2: 32, 3: 32}
#: Voxels of tiles and halos that a kernel of many tiles gets at once.
CELLS = 1 << 18


def schema_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows of equal _g, which are sorted, and where these runs end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch["_g"].to_numpy()
        if last is not None and g[0] == last and g[-1] == last:
            held.append(batch)  # the run goes on
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        g = t["_g"].to_numpy()
        ends = np.flatnonzero(g[1:] != g[:-1]) + 1
        if len(ends):
            yield t.slice(0, int(ends[-1])), ends
        held, last = t.slice(int(ends[-1]) if len(ends) else 0).to_batches(), g[-1]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.array([t.num_rows])


def on_tiles(points: DataFrame, source: DataFrame, keys: list[str], axes: list[str], at: list[str], halo: tuple[int, int], kernel: Callable, out: str, keep: list[str], columns: list[str], side: int | None = None, many: bool = False) -> DataFrame:
    """kernel(points, dense, origin) for each tile that has points; the result has the columns `keep` of the points and `out`.

    at names the points' coordinates in the order of the axes, columns the source's values. halo is how many voxels
    before and behind the voxel that holds a point are needed. The kernel gets the tile's points as an array (n, axes), for
    each of the columns a dense array over the tile and its halo (NaN where there is no voxel), a last one that tells
    where there are voxels, the coordinates of the array's first voxel, and the tile's points as a table. It returns one
    array for each column of `out`, or these and the places of the points that they belong to.

    many: the kernel gets several tiles at once, as small ones cost more to call than to compute: dense arrays
    (tiles, *shape), the first voxel for each point's tile (n, axes), a function that gives a column of the points, and each
    point's tile (n,). CELLS bounds what it gets.

    Voxels and points are dealt by tile and sorted, voxels first, so that small tiles follow each other in one stream.
    """
    d, (before, after) = len(axes), halo
    size = side or SIDES[d]
    tile = [f"_t{a}" for a in axes]
    kinds = dict(points.dtypes)
    coordinate = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    asked = points.withColumns({t: F.floor(coordinate(c) / size).cast("long") for t, c in zip(tile, at, strict=True)})
    asked = asked.withColumns({"_g": F.xxhash64(*keys, *tile), "_role": F.lit(1), **{f"_p{a}": coordinate(c) for a, c in zip(axes, at, strict=True)}, **{f"_q{a}": F.col(c).cast("double") for a, c in zip(axes, at, strict=True)}})
    held = source.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *[F.col(a).cast("double").alias(f"_p{a}") for a in axes], *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns)])
    for a, t in zip(axes, tile, strict=True):
        first, last = F.floor((F.col(f"_p{a}") - after) / size).cast("long"), F.floor((F.col(f"_p{a}") + before) / size).cast("long")
        held = held.withColumn(t, F.explode(F.sequence(first, last)))
    inside = [*tile, *[f"_p{a}" for a in axes]]
    held = held.select(F.xxhash64(*keys, *tile).alias("_g"), F.lit(0).alias("_role"), *inside, *[f"_c{k}" for k in range(len(columns))])
    rest = [c for c in points.columns if c not in inside]
    both = asked.select("_g", "_role", *inside, *[f"_q{a}" for a in axes], *rest).unionByName(held, allowMissingColumns=True)
    shape = (size + before + after,) * d
    cells = int(np.prod(shape))

    def some(t: pa.Table, column: Callable, begins: np.ndarray, ends: np.ndarray) -> tuple[list, np.ndarray]:
        """Results of the tiles of the given rows, which all have points, and the rows that they belong to."""
        length = ends - begins
        number = np.repeat(np.arange(len(length)), length)
        row = np.repeat(begins - np.cumsum(length) + length, length) + np.arange(len(number))
        origin = np.stack([column(c)[begins] for c in tile], 1) * size - before
        voxel = column("_role")[row] == 0
        at_, n = row[voxel], number[voxel]
        flat = n
        for k, a in enumerate(axes):
            flat = flat * shape[k] + (column(f"_p{a}")[at_].astype(np.int64) - origin[n, k])
        dense = []
        for k in range(len(columns)):
            x = np.full(len(length) * cells, np.nan)
            x[flat] = column(f"_c{k}")[at_]
            dense.append(x.reshape(-1, *shape))
        there = np.zeros(len(length) * cells, bool)
        there[flat] = True
        at_, n = row[~voxel], number[~voxel]
        p = np.stack([column(f"_q{a}")[at_].astype(float) for a in axes], 1)
        dense.append(there.reshape(-1, *shape))
        if many:
            got = kernel(p, dense, origin[n], lambda c: column(c)[at_], n)
        else:
            got = kernel(p, [x[0] for x in dense], origin[0], t.slice(int(at_[0]), len(at_)))
        found, kept = got if isinstance(got, tuple) else (got, slice(None))
        return found, at_[kept]

    def whole(t: pa.Table, ends: np.ndarray) -> pa.Table:
        """Results of the tiles that end at the given rows."""
        column = cache(lambda c: t[c].to_numpy())
        begins = np.concatenate([[0], ends[:-1]])
        full = np.add.reduceat(column("_role").astype(np.int64), begins) > 0
        begins, ends = begins[full], ends[full]
        use, found = [], [[] for _ in out.split(", ")]
        step = max(1, CELLS // cells) if many else 1
        for lo in range(0, len(ends), step):
            got, rows = some(t, column, begins[lo : lo + step], ends[lo : lo + step])
            use.append(rows)
            for kept, x in zip(found, got, strict=True):
                kept.append(x)
        at_ = np.concatenate(use) if use else np.empty(0, np.int64)
        return _with(t.select(keep).take(pa.array(at_)), out, [np.concatenate(x) if x else [] for x in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in runs(batches):
            yield from whole(t, ends).to_batches()

    return both.repartition("_g").sortWithinPartitions("_g", "_role").mapInArrow(run, schema_of(points, keep) + ", " + out)


def _with(rows: pa.Table, out: str, columns: list) -> pa.Table:
    for c, x in zip(out.split(", "), columns, strict=True):
        name, kind = c.split()
        rows = rows.append_column(name, pa.array(x, pa.float64() if kind == "double" else pa.int32()))
    return rows


def taps(p: np.ndarray, origin: np.ndarray, weights: list[Callable], before: int, count: int, tile: np.ndarray | None = None):
    """(index tuple into the dense arrays, weight) for each combination of taps around points; weights[k](f) gives the
    taps' weights (count, n) along axis k at the fractions f. tile: each point's tile in arrays of many."""
    first = () if tile is None else (tile,)
    low = np.floor(np.nan_to_num(p)).astype(np.int64)
    w = [weights[k](p[:, k] - low[:, k]) for k in range(p.shape[1])]
    base = low - before - origin
    for step in product(range(count), repeat=p.shape[1]):
        k = np.ones(len(p))
        for axis, i in enumerate(step):
            k = k * w[axis][i]
        yield (*first, *(base[:, axis] + i for axis, i in enumerate(step))), k
