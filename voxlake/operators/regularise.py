"""Regularisers of control grids with their slopes, slopes of tensor and descriptor measures, tensors, demeaning.

Every term is a stencil over a node's direct neighbours: nodes cast weighted copies of themselves to their neighbours,
which are summed on the map side first, and a slope casts the sums back. Two shuffles on the node key, whatever the
size of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stencil
from .estimate import ssd_gradient
from .transform import PARTS, compose, exponentiate, map_landmarks, parts_of, spline_field

#: Fixed values of the cubic B-spline and its derivatives at the nodes -1, 0, 1.
VALUE, FIRST, SECOND = [1 / 6, 2 / 3, 1 / 6], [-0.5, 0.0, 0.5], [1.0, -2.0, 1.0]


def _neighbours(axes: list[str], kinds: dict[str, dict[str, list[float]]]) -> Column:
    """Array of (d<axis>..., <kind>...): the offsets -1..1 of all axes with each kind's product weight."""
    steps: list[dict[str, int]] = [{}]
    for a in axes:
        steps = [{**s, a: d} for s in steps for d in (-1, 0, 1)]
    weight = lambda s, k: float(np.prod([k.get(a, VALUE)[s[a] + 1] for a in axes]))
    return F.array(*[F.struct(*[F.lit(s[a]).alias(f"d{a}") for a in axes], *[F.lit(weight(s, k)).alias(n) for n, k in kinds.items()]) for s in steps])


def _derivatives(nodes: DataFrame, keys: list[str], axes: list[str], kinds: dict[str, dict[str, list[float]]]) -> DataFrame:
    """_<part>_<kind> at the inner nodes, those with all neighbours."""
    cast = nodes.select(*keys, *axes, *parts_of(axes), F.explode(_neighbours(axes, kinds)).alias("o"))
    moved = cast.select(*keys, *parts_of(axes), "o", *[(F.col(a) - F.col(f"o.d{a}")).alias(a) for a in axes])
    sums = moved.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(v) * F.col(f"o.{k}")).alias(f"_{v}_{k}") for v in parts_of(axes) for k in kinds])
    return sums.where(F.col("_n") == 3 ** len(axes)).drop("_n")


def _cast_back(inner: DataFrame, keys: list[str], axes: list[str], kinds: dict, slopes: dict[str, dict[str, Column]], count: DataFrame) -> DataFrame:
    """Slope of each node's components: what each inner node says of its derivatives, times their weights there."""
    named = inner.select(*keys, *axes, *[c.alias(f"_{v}_{k}") for v, by in slopes.items() for k, c in by.items()])
    cast = named.select("*", F.explode(_neighbours(axes, kinds)).alias("o"))
    moved = cast.select(*keys, *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in axes], *[reduce(add, [F.col(f"_{v}_{k}") * F.col(f"o.{k}") for k in by]).alias(v) for v, by in slopes.items()])
    return moved.groupBy(*keys, *axes).agg(*[F.sum(v).alias(v) for v in slopes]).join(count, keys).select(*keys, *axes, *[(F.col(v) / F.col("_all")).alias(v) for v in slopes])


def _count(nodes: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg((F.count(F.lit(1)) * len(axes)).alias("_all"))


def bending_gradient(nodes: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Slope of the bending energy for each node's components: twice each second derivative, cast back."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    kinds = {a + b: {a: SECOND} if a == b else {a: FIRST, b: FIRST} for a, b in pairs}
    inner = _derivatives(nodes, keys, axes, kinds)
    slopes = {v: {a + b: (2 if a == b else 4) * F.col(f"_{v}_{a}{b}") for a, b in pairs} for v in parts_of(axes)}
    return _cast_back(inner, keys, axes, kinds, slopes, _count(nodes, keys, axes))


def _rotation(axes: list[str]) -> dict[tuple[str, str], Column]:
    """The rotation nearest to the matrix _j<component><axis>, by its entries."""
    if len(axes) == 2:
        x, y = axes
        angle = F.atan2(F.col(f"_j{y}{x}") - F.col(f"_j{x}{y}"), F.col(f"_j{x}{x}") + F.col(f"_j{y}{y}"))
        return {(x, x): F.cos(angle), (x, y): -F.sin(angle), (y, x): F.sin(angle), (y, y): F.cos(angle)}

    @F.pandas_udf("array<double>")
    def nearest(*columns: pd.Series) -> pd.Series:
        u, _, v = np.linalg.svd(np.stack([c.to_numpy(float) for c in columns], 1).reshape(-1, 3, 3))
        u[:, :, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))[:, None]
        return pd.Series(list((u @ v).reshape(-1, 9)))

    r = nearest(*[F.col(f"_j{b}{a}") for b in axes for a in axes])
    return {(b, a): r[3 * i + j] for i, b in enumerate(axes) for j, a in enumerate(axes)}


def _strain(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> tuple[DataFrame, dict]:
    """e<component><axis> at inner nodes: the grid's Jacobian (spacing: voxels between nodes) less the nearest rotation."""
    kinds = {a: {a: FIRST} for a in axes}
    inner = _derivatives(nodes, keys, axes, kinds)
    j = inner.select(*keys, *axes, *[(F.col(f"_{PARTS[b]}_{a}") / float(spacing)).alias(f"_j{b}{a}") for b in axes for a in axes])
    r = _rotation(axes)
    return j.select(*keys, *axes, *[(F.col(f"_j{b}{a}") - r[b, a]).alias(f"e{b}{a}") for b in axes for a in axes]), kinds


def linear_energy(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Sum of squared strains at the inner nodes, over the number of node components.

    The strain is the symmetric factor of the Jacobian's polar form less the identity; its length is that of the
    Jacobian less the nearest rotation, so no product is formed.
    """
    e, _ = _strain(nodes, keys, axes, spacing)
    total = reduce(add, [F.col(f"e{b}{a}") * F.col(f"e{b}{a}") for b in axes for a in axes])
    return e.groupBy(*keys).agg(F.sum(total).alias("_s")).join(_count(nodes, keys, axes), keys).select(*keys, (F.col("_s") / F.col("_all")).alias("energy"))


def linear_gradient(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Slope of linear_energy() for each node's components. The rotation is the nearest one, so it adds no term."""
    e, kinds = _strain(nodes, keys, axes, spacing)
    slopes = {PARTS[b]: {a: F.col(f"e{b}{a}") * (2 / float(spacing)) for a in axes} for b in axes}
    return _cast_back(e, keys, axes, kinds, slopes, _count(nodes, keys, axes))


def dti_gradient(pair: DataFrame, keys: list[str], point: list[str], axes: list[str]) -> DataFrame:
    """g<axis> of the tensor distance. The pair has r0..r5, w0..w5 (xx, xy, yy, xz, yz, zz) and slopes s<channel><axis>."""
    d = [F.col(f"r{k}") - F.col(f"w{k}") for k in range(6)]
    trace = d[0] + d[2] + d[5]
    weight = [2 * d[k] - 2 / 3 * trace if k in (0, 2, 5) else 4 * d[k] for k in range(6)]
    n = pair.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    return pair.join(n, keys).select(*keys, *point, *[(-reduce(add, [weight[k] * F.col(f"s{k}{a}") for k in range(6)]) / F.col("_all")).alias(f"g{a}") for a in axes])


def mind_gradient(reference: DataFrame, warped: DataFrame, keys: list[str], axes: list[str], context: bool = False) -> DataFrame:
    """g<axis>: slopes of the squared difference of descriptors, each channel by its own central differences."""
    describe = stencil.mind_ssc if context else stencil.mind
    r, w = describe(reference, keys, axes), describe(warped, keys, axes)
    channels = [c for c in r.columns if c not in (*keys, *axes)]
    rows = lambda df: df.select(*keys, *axes, F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).alias("v")) for k, c in enumerate(channels)])).alias("o")).select(*keys, *axes, F.col("o.c").alias("channel"), F.col("o.v").alias("value"))
    on = [*keys, "channel"]
    slopes = stencil.gradient(rows(w), on, axes).select(*on, *axes, F.col("value").alias("w"), *[F.col(f"g{a}").alias(f"s{a}") for a in axes])
    g = ssd_gradient(rows(r).join(slopes, [*on, *axes]), on, axes)
    return g.groupBy(*keys, *axes).agg(*[F.sum(f"g{a}").alias(f"g{a}") for a in axes])


def _spectral(tensors: DataFrame, fn) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.array([[0, 1, 3], [1, 2, 4], [3, 4, 5]])
        for b in batches:
            m = b[[f"d{k}" for k in range(6)]].to_numpy(float)[:, at]
            ok = np.isfinite(m).all((1, 2))
            out = np.full((len(b), 6), np.nan)
            vals, vecs = np.linalg.eigh(m[ok])
            full = (vecs * fn(vals)[:, None, :]) @ np.swapaxes(vecs, 1, 2)
            out[ok] = full[:, [0, 1, 1, 2, 2, 2], [0, 0, 1, 0, 1, 2]]
            yield b.assign(**{f"d{k}": out[:, k] for k in range(6)})

    return tensors.mapInPandas(run, tensors.schema)


def tensor_log(tensors: DataFrame) -> DataFrame:
    """Matrix logarithm of symmetric tensors d0..d5 (xx, xy, yy, xz, yz, zz); eigenvalues not above 0 count as the least
    positive double. Tensors with a NaN stay NaN. Logarithms are what may be interpolated."""
    return _spectral(tensors, lambda v: np.log(np.maximum(v, np.finfo(float).tiny)))


def tensor_rotate(tensors: DataFrame) -> DataFrame:
    """Symmetric tensors d0..d5 turned by the rotation nearest to the Jacobian j<component><axis> of their voxel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.array([[0, 1, 3], [1, 2, 4], [3, 4, 5]])
        for b in batches:
            m = b[[f"d{k}" for k in range(6)]].to_numpy(float)[:, at]
            j = b[[f"j{r}{c}" for r in "xyz" for c in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
            ok = np.isfinite(m).all((1, 2)) & np.isfinite(j).all((1, 2))
            out = np.full((len(b), 6), np.nan)
            u, _, v = np.linalg.svd(j[ok])
            u[:, :, 2] *= np.sign(np.linalg.det(u @ v))[:, None]
            r = u @ v
            full = r @ m[ok] @ np.swapaxes(r, 1, 2)
            out[ok] = full[:, [0, 1, 1, 2, 2, 2], [0, 0, 1, 0, 1, 2]]
            yield b.assign(**{f"d{k}": out[:, k] for k in range(6)})

    return tensors.mapInPandas(run, tensors.schema)


def tensor_exp(tensors: DataFrame) -> DataFrame:
    return _spectral(tensors, np.exp)


def demeaned_fields(fields: DataFrame, axes: list[str]) -> DataFrame:
    """Fields of several images less the mean displacement over all images at each voxel."""
    mean = fields.groupBy(*axes).agg(*[F.avg(F.col(PARTS[a]) - F.col(a)).alias(f"_m{a}") for a in axes])
    return fields.join(mean, axes).withColumns({PARTS[a]: F.col(PARTS[a]) - F.col(f"_m{a}") for a in axes}).drop(*[f"_m{a}" for a in axes])


def demeaned_velocities(grids: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Velocity grids (displacements of nodes; keys name the image) without what an affine of each grid explains, less the
    mean of these over all images at each node. The affine is the least-squares one, fitted from sums by key."""
    n, at, v = len(axes), [F.col(a).cast("double") for a in axes], [F.col(PARTS[a]) for a in axes]
    sums = [F.count(F.lit(1)).alias("_n")] + [F.sum(c).alias(f"_s{i}") for i, c in enumerate(at)] + [F.sum(c).alias(f"_t{i}") for i, c in enumerate(v)]
    sums += [F.sum(at[i] * at[j]).alias(f"_q{i}{j}") for i in range(n) for j in range(n)] + [F.sum(at[i] * v[j]).alias(f"_r{i}{j}") for i in range(n) for j in range(n)]
    names = [f"_a{i}{j}" for i in range(n) for j in range(n + 1)]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gram, right = np.zeros((len(b), n + 1, n + 1)), np.zeros((len(b), n + 1, n))
            gram[:, n, n] = b["_n"]
            for i in range(n):
                gram[:, i, n] = gram[:, n, i] = b[f"_s{i}"]
                right[:, n, i] = b[f"_t{i}"]
                for j in range(n):
                    gram[:, i, j], right[:, i, j] = b[f"_q{i}{j}"], b[f"_r{i}{j}"]
            a = np.swapaxes(np.linalg.pinv(gram) @ right, 1, 2).reshape(len(b), -1)
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(a, columns=names)], axis=1)

    grouped = grids.groupBy(*keys).agg(*sums)
    schema = ", ".join([*(f"`{k}` {dict(grouped.dtypes)[k]}" for k in keys), *(f"{x} double" for x in names)])
    affine = grouped.mapInPandas(fit, schema)
    rest = {PARTS[a]: F.col(PARTS[a]) - reduce(add, [F.col(f"_a{i}{j}") * at[j] for j in range(n)]) - F.col(f"_a{i}{n}") for i, a in enumerate(axes)}
    free = grids.join(affine, keys).select(*keys, *axes, *[c.alias(p) for p, c in rest.items()])
    mean = free.groupBy(*axes).agg(*[F.avg(p).alias(f"_m{p}") for p in parts_of(axes)])
    return free.join(mean, axes).select(*keys, *axes, *[(F.col(p) - F.col(f"_m{p}")).alias(p) for p in parts_of(axes)])


def linear_spline_field(voxels: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Dense field that runs straight between the nodes of a grid, `spacing` voxels apart."""
    at = voxels.withColumns({f"p{a}": F.col(a) / float(spacing) + 1 for a in axes})
    return map_landmarks(at, nodes, keys, axes, axes)


def velocity_field(voxels: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, dim: dict[str, int], squarings: int = 6) -> DataFrame:
    """Deformation of a velocity grid (node displacements): its dense flow, then scaling and squaring."""
    return exponentiate(spline_field(voxels, nodes, keys, axes, spacing), keys, axes, dim, squarings)


def composed(second: DataFrame, first: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> DataFrame:
    """second(first(x)) of any two transformations, each already made a dense field by the function for its kind."""
    return compose(second, first, keys, axes, dim)
