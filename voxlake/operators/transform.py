"""Transformations: affine and dense fields, B-spline grids, composition, Jacobians, velocity fields.

A dense field is a frame of voxels with vx, vy (and vz): the position in the target space. A control grid is a frame of
nodes (x, y, and z) with the same components; it has one node of border, so node 1 sits on the image's first voxel.
Small matrices live on the driver as row-major lists of 16.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import B_SPLINE, B_SPLINE_D, horner, safe_ln
from .lattice import lattice_sums
from .lineage import cut
from .resample import resample_components
from .voxel import grid, world

PARTS = {"x": "vx", "y": "vy", "z": "vz"}


def parts_of(axes: list[str]) -> list[str]:
    return [PARTS[a] for a in axes]


def affine_field(voxels: DataFrame, m: list[float], axes: list[str]) -> DataFrame:
    """Field of an affine over voxels; m already holds affine times voxel-to-world."""
    w = world(m, tuple(a if a in axes else None for a in "xyz"))
    return voxels.withColumns({PARTS[a]: w[k] for k, a in enumerate("xyz") if a in axes})


def affine_after(field: DataFrame, m: list[float], axes: list[str]) -> DataFrame:
    """The affine applied to the positions that a field holds."""
    v = [F.col(PARTS[a]) if a in axes else F.lit(0.0) for a in "xyz"]
    new = [m[4 * r] * v[0] + m[4 * r + 1] * v[1] + m[4 * r + 2] * v[2] + m[4 * r + 3] for r in range(3)]
    return field.withColumns({PARTS[a]: new[k] for k, a in enumerate("xyz") if a in axes})


def _spline_points(points: DataFrame, axes: list[str], basis: dict[str, list]) -> DataFrame:
    """Rows of points times 4^d nodes, from q<axis> (lattice coordinates, node 1 = first voxel): g<axis> and _k."""
    out = points
    for a in axes:
        q = F.col(f"q{a}")
        f = q - F.floor(q)
        taps = F.array(*[F.struct((F.floor(q) - 1 + i).cast("int").alias("t"), horner(f, *c).alias("k")) for i, c in enumerate(basis[a])])
        out = out.withColumn(f"_g{a}", F.explode(taps))
    k = reduce(lambda x, y: x * y, [F.col(f"_g{a}.k") for a in axes])
    return out.withColumn("_k", k).withColumns({f"_n{a}": F.col(f"_g{a}.t") for a in axes}).drop(*[f"_g{a}" for a in axes])


def spline_sum(points: DataFrame, nodes: DataFrame, keys: list[str], point: list[str], axes: list[str], derivative: str | None = None, whole: bool = False) -> DataFrame:
    """B-spline sums of the node components at lattice coordinates q<axis>; nodes that don't exist add nothing.

    whole: points without all their nodes are left out. Nodes and points meet on tiles of the lattice (lattice.py).
    """
    return lattice_sums(points, nodes, keys, point, axes, [(derivative, {v: v for v in parts_of(axes)})], whole=whole)


def spline_field(voxels: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Dense field of a control grid whose nodes are `spacing` voxels apart."""
    at = voxels.withColumns({f"q{a}": F.col(a) / float(spacing) + 1 for a in axes})
    return spline_sum(at, nodes, keys, axes, axes)


def spline_jacobian(voxels: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, kind: str = "cubic") -> DataFrame:
    """j<component><axis> and det of a cubic or piecewise linear control grid at voxels, in units of node displacement a
    voxel. All slopes are taken on the same tiles."""
    at = voxels.withColumns({f"q{a}": F.col(a) / float(spacing) + 1 for a in axes})
    wanted = [(a, {PARTS[b]: f"j{b}{a}" for b in axes}) for a in axes]
    got = lattice_sums(at, nodes, keys, axes, axes, wanted, kind)
    return got.withColumns({f"j{b}{a}": F.col(f"j{b}{a}") / float(spacing) for a in axes for b in axes}).withColumn("det", determinant(axes))


def determinant(axes: list[str]) -> Column:
    j = {(a, b): F.col(f"j{a}{b}") for a in axes for b in axes}
    if len(axes) == 2:
        return j["x", "x"] * j["y", "y"] - j["x", "y"] * j["y", "x"]
    minor = lambda a, b, c, d: j[a] * j[b] - j[c] * j[d]
    return (
        j["x", "x"] * minor(("y", "y"), ("z", "z"), ("y", "z"), ("z", "y"))
        - j["x", "y"] * minor(("y", "x"), ("z", "z"), ("y", "z"), ("z", "x"))
        + j["x", "z"] * minor(("y", "x"), ("z", "y"), ("y", "y"), ("z", "x"))
    )


def field_jacobian(field: DataFrame, keys: list[str], axes: list[str], spacing: dict[str, float] | None = None) -> DataFrame:
    """Forward differences of a dense field (the last voxel of a line repeats the one before) and their determinant. Lines may have gaps."""
    out = {}
    for a in axes:
        w = W.partitionBy(*keys, *[b for b in axes if b != a]).orderBy(a)
        for b in axes:
            v = F.col(PARTS[b])
            ahead, back = F.max(v).over(w.rangeBetween(1, 1)) - v, v - F.max(v).over(w.rangeBetween(-1, -1))
            out[f"j{b}{a}"] = F.coalesce(ahead, back, F.lit(0.0)) / float((spacing or {}).get(a, 1.0))
    return field.withColumns(out).withColumn("det", determinant(axes))


def log_determinant(jacobian: DataFrame) -> DataFrame:
    return jacobian.withColumn("log_det", safe_ln(F.col("det")))


def compose(first: DataFrame, second: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> DataFrame:
    """first(second(x)) of dense fields in voxel units; beyond first's edge its edge value moves on with the point.

    The first field is a lattice of its own voxels, read linearly on tiles.
    """
    inside = {f"_i{a}": F.least(F.greatest(F.col(PARTS[a]), F.lit(0.0)), F.lit(float(dim[a] - 1))) for a in axes}
    at = second.select(*keys, *axes, *parts_of(axes)).withColumns(inside)
    at = at.select(*keys, *axes, *inside, *[(F.col(PARTS[a]) - F.col(f"_i{a}")).alias(f"_o{a}") for a in axes])
    beyond = [f"_o{a}" for a in axes]
    wanted = [(None, {v: v for v in parts_of(axes)})]
    met = lattice_sums(at, first, keys, [*axes, *beyond], axes, wanted, "linear", coordinates=list(inside))
    return met.select(*keys, *axes, *[(F.col(PARTS[a]) + F.col(f"_o{a}")).alias(PARTS[a]) for a in axes])


def longest_component(flow: DataFrame, axes: list[str]) -> float:
    """Largest magnitude of a component, over all vectors of the frame."""
    return flow.agg(F.max(F.greatest(*[F.abs(F.col(PARTS[a])) for a in axes], F.lit(0.0)))).first()[0] or 0.0


def intermediate_fields(flow: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], squarings: int | None = None, backward: bool = False) -> list[DataFrame]:
    """The scaled flow as a deformation and what each squaring makes of it, the last one the whole deformation.

    flow holds displacements. squarings None: as many as keep the longest step short (squarings_for). backward: the
    inverse, by the flow's negative. Each squaring is checkpointed.
    """
    if squarings is None:
        squarings = squarings_for(longest_component(flow, axes), len(axes))
    scale = float(2**squarings) * (-1 if backward else 1)
    fields = [flow.select(*keys, *axes, *[(F.col(a) + F.col(PARTS[a]) / scale).alias(PARTS[a]) for a in axes])]
    for _ in range(squarings):
        fields.append(cut(compose(fields[-1], fields[-1], keys, axes, dim)))
    return fields


def exponentiate(flow: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], squarings: int | None = None, backward: bool = False, affine: list[float] | None = None) -> DataFrame:
    """Deformation of a stationary displacement flow by scaling and squaring.

    affine (row-major 4 by 4, in voxels) is a part of the flow that isn't squared: its displacement is taken off before
    and put back at the end.
    """
    fixed = {PARTS[a]: c - F.col(a) for a, c in zip("xyz", world(affine, tuple(a if a in axes else None for a in "xyz")), strict=True) if a in axes} if affine else {}
    field = intermediate_fields(flow.withColumns({v: F.col(v) - c for v, c in fixed.items()}), keys, axes, dim, squarings, backward)[-1]
    return field.withColumns({v: F.col(v) + c for v, c in fixed.items()})


def flow_jacobian(flow: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], squarings: int | None = None, backward: bool = False) -> DataFrame:
    """j<component><axis> and det of a flow's deformation as the product of the matrices of all squarings but the last.

    The matrices belong to the voxels themselves, not to where the squarings lead them.
    """
    out = None
    for field in intermediate_fields(flow, keys, axes, dim, squarings, backward)[:-1]:
        now = field_jacobian(field, keys, axes).select(*keys, *axes, *[F.col(f"j{b}{a}").alias(f"_j{b}{a}") for b in axes for a in axes])
        if out is None:
            out = now.select(*keys, *axes, *[F.col(f"_j{b}{a}").alias(f"j{b}{a}") for b in axes for a in axes])
            continue
        product = {f"j{b}{a}": reduce(lambda p, q: p + q, [F.col(f"_j{b}{c}") * F.col(f"j{c}{a}") for c in axes]) for b in axes for a in axes}
        out = out.join(now, [*keys, *axes]).select(*keys, *axes, *[c.alias(n) for n, c in product.items()])
    return out.withColumn("det", determinant(axes))


def compose_grids(first: DataFrame, second: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Control grid whose nodes are those of the second, moved on by the first: first(second(x)).

    Grids hold positions in voxels, nodes `spacing` voxels apart; beyond its nodes the first moves nothing.
    """
    moves = first.withColumns({PARTS[a]: F.col(PARTS[a]) - (F.col(a) - 1) * float(spacing) for a in axes})
    at = second.withColumns({f"q{a}": F.col(PARTS[a]) / float(spacing) + 1 for a in axes})
    got = spline_sum(at, moves, keys, axes, axes).select(*keys, *axes, *[F.col(PARTS[a]).alias(f"_d{a}") for a in axes])
    return second.join(got, [*keys, *axes], "left").select(*keys, *axes, *[(F.col(PARTS[a]) + F.coalesce(f"_d{a}", F.lit(0.0))).alias(PARTS[a]) for a in axes])


def squarings_for(longest: float, dimensions: int, least: int = 6) -> int:
    """Smallest number of halvings that brings the longest step under 0.28 (3D) or 0.35 (2D) voxels, at least 6."""
    n = 0
    while longest / 2**n >= (0.28 if dimensions == 3 else 0.35):
        n += 1
    return max(n, least)


def invert_field(field: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], rounds: int = 20) -> DataFrame:
    """Dense inverse by fixed point iteration: the inverse displacement at x is minus the displacement where it leads."""
    inv = field.select(*keys, *axes, *[F.col(a).cast("double").alias(PARTS[a]) for a in axes])
    for n in range(rounds):
        moved = compose(field, inv, keys, axes, dim).select(*keys, *axes, *[F.col(PARTS[a]).alias(f"_f{a}") for a in axes])
        inv = inv.join(moved, [*keys, *axes]).select(*keys, *axes, *[(F.col(PARTS[a]) - (F.col(f"_f{a}") - F.col(a))).alias(PARTS[a]) for a in axes])
        if n % 5 == 4:
            inv = cut(inv)
    return inv


def nodes_along(voxels: int, spacing: float) -> int:
    """Nodes of a control grid along an axis of so many voxels: one before them, two behind."""
    return math.ceil(voxels / spacing) + 3


def control_grid(spark: SparkSession, dim: dict[str, int], spacing: float) -> DataFrame:
    """Nodes of an identity grid for an image: ceil(n / spacing) + 3 an axis, positions in voxels."""
    n = [nodes_along(dim[a], spacing) if a in dim else 1 for a in "xyz"]
    g = grid(spark, *n)
    return g.select(*dim, *[((F.col(a) - 1) * float(spacing)).alias(PARTS[a]) for a in dim])


def middle_grids(spark: SparkSession, dim: dict[str, int], other_dim: dict[str, int], affine: list[float], spacing: float) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, int]]]:
    """Identity grids for a symmetric registration, in the space half way between both images, and its first and last
    voxel along each axis.

    affine leads from the reference's voxels to the floating image's. Half of it leads the reference's corners into the
    middle, the inverse of half of it the other image's; the grids cover all of these. Both hold positions in the middle
    space, nodes `spacing` voxels apart from the first voxel on.
    """
    import numpy as np

    from .matrix import half

    axes, h = list(dim), half(np.reshape(affine, (4, 4)))
    corners = lambda size: np.array([[*[(size.get(a, 1) - 1) * (i >> k & 1) for k, a in enumerate("xyz")], 1.0] for i in range(8)])
    seen = np.concatenate([corners(dim) @ h.T, corners(other_dim) @ np.linalg.inv(h).T])
    box = {a: (math.floor(seen[:, k].min() + 1e-9), math.ceil(seen[:, k].max() - 1e-9)) for k, a in enumerate("xyz") if a in axes}
    nodes = control_grid(spark, {a: hi - lo + 1 for a, (lo, hi) in box.items()}, spacing)
    placed = nodes.withColumns({PARTS[a]: F.col(PARTS[a]) + float(box[a][0]) for a in axes})
    return placed, placed, box


def refine_grid(nodes: DataFrame, keys: list[str], axes: list[str], finer: list[str] | None = None) -> DataFrame:
    """Grid of half the spacing with the same field: an old node keeps [1/8, 3/4, 1/8] of its line, a new node between
    two takes half of each. Outside nodes count as 0, as the displacement form asks for. finer: the axes to refine, else all."""
    out = nodes
    for a in axes if finer is None else finer:
        rest = [b for b in axes if b != a]
        shares = [(-2, 1 / 8), (-1, 1 / 2), (0, 3 / 4), (1, 1 / 2), (2, 1 / 8)]
        cast = out.select(*keys, *rest, F.explode(F.array(*[F.struct((F.col(a) * 2 - 1 + d).alias("t"), F.lit(k).alias("k")) for d, k in shares])).alias("_s"), *parts_of(axes))
        out = cast.groupBy(*keys, *rest, F.col("_s.t").alias(a)).agg(*[F.sum(F.col(v) * F.col("_s.k")).alias(v) for v in parts_of(axes)])
    return out


def bending_energy(nodes: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Sum of squared second derivatives at inner nodes (mixed ones twice), over the number of node components."""
    value, second, first = [1 / 6, 2 / 3, 1 / 6], [1.0, -2.0, 1.0], [-0.5, 0.0, 0.5]
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    steps = [{}]
    for a in axes:
        steps = [{**s, a: d} for s in steps for d in (-1, 0, 1)]

    def weight(s: dict, a: str, b: str) -> float:
        out = 1.0
        for x in axes:
            out *= (second if a == b == x else first if x in (a, b) else value)[s[x] + 1]
        return out

    offsets = F.explode(F.array(*[F.struct(*[F.lit(s[a]).alias(f"d{a}") for a in axes], *[F.lit(weight(s, a, b)).alias(f"w{a}{b}") for a, b in pairs]) for s in steps])).alias("o")
    cast = nodes.select(*keys, *parts_of(axes), offsets, *axes).select(*keys, *parts_of(axes), "o", *[(F.col(a) - F.col(f"o.d{a}")).alias(a) for a in axes])
    sums = cast.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(v) * F.col(f"o.w{a}{b}")).alias(f"_{v}{a}{b}") for v in parts_of(axes) for a, b in pairs])
    inner = sums.where(F.col("_n") == len(steps))
    total = reduce(lambda p, q: p + q, [(1 if a == b else 2) * F.col(f"_{v}{a}{b}") * F.col(f"_{v}{a}{b}") for v in parts_of(axes) for a, b in pairs])
    n = nodes.groupBy(*keys).agg((F.count(F.lit(1)) * len(axes)).alias("_all"))
    return inner.groupBy(*keys).agg(F.sum(total).alias("_s")).join(n, keys).select(*keys, (F.col("_s") / F.col("_all")).alias("energy")) if keys else inner.agg(F.sum(total).alias("_s")).crossJoin(n).select((F.col("_s") / F.col("_all")).alias("energy"))


def bending_of_arrays(parts: list[np.ndarray], there: np.ndarray) -> np.ndarray | None:
    """bending_energy() of grids as arrays (grids, *shape) that have nodes at the same places; None without inner nodes."""
    value, second, first = np.array([[1 / 6, 2 / 3, 1 / 6], [1.0, -2.0, 1.0], [-0.5, 0.0, 0.5]])
    d = there.ndim
    if min(there.shape) < 3:
        return None

    def along(x: np.ndarray, taps: list[np.ndarray]) -> np.ndarray:
        """Sums over the neighbours along the last axes, at places that have them."""
        for k, w in enumerate(taps):
            axis = x.ndim - d + k
            n = x.shape[axis] - 2
            x = sum(w[i] * x[(slice(None),) * axis + (slice(i, i + n),)] for i in range(3))
        return x

    inner = along(there.astype(float), [np.ones(3)] * d) == 3**d
    if not inner.any():
        return None
    total = 0.0
    for a in range(d):
        for b in range(a, d):
            taps = [second if a == b == k else first if k in (a, b) else value for k in range(d)]
            for x in parts:
                total = total + (1 if a == b else 2) * (np.where(inner, along(x, taps), 0.0) ** 2).reshape(len(x), -1).sum(1)
    return total / (np.count_nonzero(there) * d)


def jacobian_penalty(jacobian: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared log determinant; NaN as soon as one determinant is below 0, which tells of folding."""
    ln = safe_ln(F.col("det"))
    return jacobian.groupBy(*keys).agg(F.avg(ln * ln).alias("penalty"))


def map_landmarks(landmarks: DataFrame, field: DataFrame, keys: list[str], axes: list[str], point: list[str]) -> DataFrame:
    """Positions that a dense field gives to points p<axis>, sampled linearly."""
    return resample_components(field, landmarks, keys, axes, point, parts_of(axes), 1, float("nan"))


def landmark_distance(landmarks: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], point: list[str]) -> DataFrame:
    """Sum of squared distances between spline positions of points q<axis> and their targets t<axis>. Points that aren't
    within the grid don't count."""
    got = spline_sum(landmarks, nodes, keys, point, axes, whole=True).join(landmarks.select(*keys, *point, *[f"t{a}" for a in axes]), [*keys, *point])
    d = reduce(lambda p, q: p + q, [(F.col(PARTS[a]) - F.col(f"t{a}")) ** 2 for a in axes])
    return got.groupBy(*keys).agg(F.sum(d).alias("distance"))


def landmark_gradient(landmarks: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], point: list[str]) -> DataFrame:
    """Slope of landmark_distance() for each node's components: residuals scattered over the nodes of each point."""
    got = spline_sum(landmarks, nodes, keys, point, axes, whole=True)
    res = landmarks.join(got, [*keys, *point]).withColumns({f"_e{a}": 2 * (F.col(PARTS[a]) - F.col(f"t{a}")) for a in axes})
    spread = _spline_points(res, axes, {a: B_SPLINE for a in axes})
    return spread.groupBy(*keys, *[F.col(f"_n{a}").alias(a) for a in axes]).agg(*[F.sum(F.col(f"_e{a}") * F.col("_k")).alias(PARTS[a]) for a in axes])


def resample_vectors(field: DataFrame, points: DataFrame, keys: list[str], axes: list[str], point: list[str]) -> DataFrame:
    """Components of a vector field at points, linear, 0 outside, turned by the transpose of the points' Jacobian j.. ."""
    turns = [f"j{b}{a}" for b in axes for a in axes]
    got = resample_components(field, points, keys, axes, [*point, *turns], parts_of(axes), 1)
    turned = {PARTS[a]: reduce(lambda p, q: p + q, [F.col(f"j{b}{a}") * F.col(PARTS[b]) for b in axes]) for a in axes}
    return got.select(*keys, *point, *[c.alias(n) for n, c in turned.items()])


def to_nodes(gradient: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """Voxel gradient read linearly at the nodes' voxels and scaled by the spacing in each axis."""
    at = nodes.select(*keys, *axes, *[((F.col(a) - 1) * float(spacing)).alias(f"p{a}") for a in axes])
    got = resample_components(gradient, at, keys, axes, axes, parts_of(axes), 1)
    return got.select(*keys, *axes, *[(F.col(v) * float(spacing)).alias(v) for v in parts_of(axes)])


def lie_bracket(*_args):
    """Not offered: the update by the bracket is switched off wherever it was described."""
    raise NotImplementedError("velocity updates by the Lie bracket are not supported")
