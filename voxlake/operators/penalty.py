"""Penalty on the Jacobian of control grids, its slope, repair of folds, and slopes by finite differences.

Penalty, slope and repair look at the Jacobian at the inner nodes or, where voxels are given, at each of these. Slopes of
voxels are summed into the nodes that reach them on tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ln
from .lattice import voxel_sums
from .lineage import cut
from .regularise import FIRST, _cast_back, _derivatives
from .tiles import runs, schema_of
from .transform import PARTS, determinant, parts_of, spline_jacobian


def node_jacobians(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float) -> DataFrame:
    """j<component><axis> and det at the inner nodes of a grid, `spacing` voxels apart."""
    inner = _derivatives(nodes, keys, axes, {a: {a: FIRST} for a in axes})
    return inner.select(*keys, *axes, *[(F.col(f"_{PARTS[b]}_{a}") / float(spacing)).alias(f"j{b}{a}") for b in axes for a in axes]).withColumn("det", determinant(axes))


def cofactor(axes: list[str], b: str, a: str) -> Column:
    """Slope of the determinant for the entry j<b><a>."""
    rest_b, rest_a = [x for x in axes if x != b], [x for x in axes if x != a]
    sign = 1.0 if (axes.index(a) + axes.index(b)) % 2 == 0 else -1.0
    j = lambda x, y: F.col(f"j{x}{y}")
    if len(axes) == 2:
        return sign * j(rest_b[0], rest_a[0])
    return sign * (j(rest_b[0], rest_a[0]) * j(rest_b[1], rest_a[1]) - j(rest_b[0], rest_a[1]) * j(rest_b[1], rest_a[0]))


def _jacobians(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, voxels: DataFrame | None) -> DataFrame:
    return node_jacobians(nodes, keys, axes, spacing) if voxels is None else spline_jacobian(voxels, nodes, keys, axes, spacing)


def _into_nodes(jacobians: DataFrame, nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, factor: Column) -> DataFrame:
    """The nodes and g<component>: slope of the determinants of voxels, each times its factor, for the node's components."""
    entries = [(b, a) for b in axes for a in axes]
    weighed = jacobians.select(*keys, *axes, *[(factor * cofactor(axes, b, a)).alias(f"_w{b}{a}") for b, a in entries])
    return voxel_sums(nodes, weighed, keys, axes, spacing, {f"g{PARTS[b]}": [(f"_w{b}{a}", a) for a in axes] for b in axes})


def grid_penalty(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, voxels: DataFrame | None = None) -> DataFrame:
    """Mean squared log determinant at the inner nodes or the voxels; NaN as soon as one is below 0."""
    ln = safe_ln(F.col("det"))
    return _jacobians(nodes, keys, axes, spacing, voxels).groupBy(*keys).agg(F.avg(ln * ln).alias("penalty"))


def penalty_gradient(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, voxels: DataFrame | None = None) -> DataFrame:
    """Slope of the sum of squared log determinants at the inner nodes for each node's components, over the number of
    nodes; with voxels, at these and over their number. Where the grid folds, inner nodes and voxels say nothing."""
    if voxels is not None:
        j = spline_jacobian(voxels, nodes, keys, axes, spacing).where("det > 0")
        number = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        sums = _into_nodes(j, nodes, keys, axes, spacing, 2 * F.ln("det") / F.col("det"))
        return sums.join(number, keys).select(*keys, *axes, *[(F.col(f"g{v}") / F.col("_all")).alias(v) for v in parts_of(axes)])
    j = node_jacobians(nodes, keys, axes, spacing).where("det > 0")
    k = 2 * F.ln("det") / F.col("det") / float(spacing)
    slopes = {PARTS[b]: {a: k * cofactor(axes, b, a) for a in axes} for b in axes}
    return _cast_back(j, keys, axes, {a: {a: FIRST} for a in axes}, slopes, nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")))


def correct_folding(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, voxels: DataFrame | None = None) -> DataFrame:
    """Nodes around an inner node where the grid folds, or in reach of a voxel where it does, moved by a fifth of a voxel
    along the slope of the determinants there. Grids that don't fold stay as they are."""
    folded = _jacobians(nodes, keys, axes, spacing, voxels).where("det <= 0")
    if voxels is None:
        slopes = {PARTS[b]: {a: cofactor(axes, b, a) for a in axes} for b in axes}
        one = nodes.select(*keys).distinct().withColumn("_all", F.lit(1))
        g = _cast_back(folded, keys, axes, {a: {a: FIRST} for a in axes}, slopes, one).select(*keys, *axes, *[F.col(v).alias(f"g{v}") for v in parts_of(axes)])
        moved = nodes.join(g, [*keys, *axes], "left")
    else:
        moved = _into_nodes(folded, nodes, keys, axes, spacing, F.lit(1.0))
    length = F.sqrt(reduce(add, [F.col(f"g{v}") * F.col(f"g{v}") for v in parts_of(axes)]))
    return moved.select(*keys, *axes, *[(F.col(v) + F.when(length > 0, F.col(f"g{v}") / (5 * length)).otherwise(F.lit(0.0))).alias(v) for v in parts_of(axes)])


def unfold(nodes: DataFrame, keys: list[str], axes: list[str], spacing: float, rounds: int = 20, voxels: DataFrame | None = None) -> DataFrame:
    """correct_folding() again and again until no grid folds at its inner nodes or voxels, at most `rounds` times."""
    for _ in range(rounds):
        if _jacobians(nodes, keys, axes, spacing, voxels).where("det <= 0").isEmpty():
            break
        nodes = cut(correct_folding(nodes, keys, axes, spacing, voxels))
    return nodes


def finite_differences(nodes: DataFrame, keys: list[str], axes: list[str], objective: Callable[[DataFrame, list[str]], DataFrame], reach: float) -> DataFrame:
    """Slope of any objective for each node's components by central differences, to check slopes with.

    objective(grids, keys) gives keys and `value` of each grid. Every grid is copied for each component and sign, and all
    copies are evaluated at once, so work grows with the square of the number of nodes.
    """
    copies = _copies(nodes, keys, axes)
    variant = [*[f"_c{a}" for a in axes], "_part", "_sign"]
    here = reduce(lambda p, q: p & q, [F.col(a) == F.col(f"_c{a}") for a in axes])
    moved = nodes.join(copies, keys).withColumns({v: F.col(v) + F.when(here & (F.col("_part") == v), F.col("_sign") * reach).otherwise(F.lit(0.0)) for v in parts_of(axes)})
    values = objective(moved, [*keys, *variant])
    slope = F.sum(F.col("_sign") * F.col("value")) / (2 * reach)
    by = values.groupBy(*keys, *[f"_c{a}" for a in axes], "_part").agg(slope.alias("_s"))
    return by.groupBy(*keys, *[F.col(f"_c{a}").alias(a) for a in axes]).agg(*[F.max(F.when(F.col("_part") == v, F.col("_s"))).alias(v) for v in parts_of(axes)])


#: Nodes of all copies that a task holds at once.
HELD = 1 << 18


def array_differences(nodes: DataFrame, keys: list[str], axes: list[str], value: Callable[[list[np.ndarray], np.ndarray], np.ndarray | None], reach: float) -> DataFrame:
    """finite_differences() of an objective of arrays, without a row for each copy's node.

    value(parts, there) gives the objective of each copy, or None where the grid has none (no rows then): parts are the
    components (copies, *shape), there tells at which places of the box (*shape) the grid has nodes. A task holds one grid
    and as many of its copies as HELD allows, small grids of the same nodes together; the copies of larger grids go to
    several tasks. Null counts as 0, as sums leave it out.
    """
    names, d = parts_of(axes), len(axes)
    number = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    each = F.greatest(F.floor(F.lit(HELD) / F.col("_all")), F.lit(1))
    blocks = number.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / each).cast("int"))).alias("_block"))
    rows = nodes.join(blocks, keys).select(F.xxhash64(*keys, "_block").alias("_g"), *keys, "_block", *axes, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in names])

    def slopes(there: np.ndarray, place: np.ndarray, mine: np.ndarray, held: list[np.ndarray]) -> list[np.ndarray] | None:
        """Slopes (grids, mine) of grids of the same nodes, whose components (grids, nodes) are at the places of the box."""
        m = len(mine)
        boxes = []
        for v in held:
            x = np.zeros((len(v), m, there.size))
            x[:, :, place] = v[:, None, :]
            boxes.append(x)
        found = []
        for x in boxes:
            ends = []
            for step in (reach, -reach):
                before = x[:, np.arange(m), place[mine]]
                x[:, np.arange(m), place[mine]] = before + step
                ends.append(value([y.reshape(-1, *there.shape) for y in boxes], there))
                x[:, np.arange(m), place[mine]] = before
            if ends[0] is None:
                return None
            found.append(((ends[0] - ends[1]) / (2 * reach)).reshape(-1, m))
        return found

    def whole(t: pa.Table, ends: np.ndarray) -> pa.Table:
        change = np.zeros(t.num_rows, bool)
        change[0], change[ends[:-1]] = True, True
        for c in (*keys, "_block"):  # grids whose hashes are the same
            change[1:] |= pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy()
        begins = np.flatnonzero(change)
        length = np.diff(np.append(begins, t.num_rows))
        at = np.stack([t[a].to_numpy() for a in axes], 1).astype(np.int64)
        low = np.minimum.reduceat(at, begins)
        shape = np.maximum.reduceat(at, begins) - low + 1
        flat = np.zeros(len(at), np.int64)
        for k in range(d):
            flat = flat * np.repeat(shape[:, k], length) + at[:, k] - np.repeat(low[:, k], length)
        block, alike = t["_block"].to_numpy()[begins], {}
        for k, (lo, n) in enumerate(zip(begins.tolist(), length.tolist(), strict=True)):
            alike.setdefault((int(block[k]), tuple(shape[k]), flat[lo : lo + n].tobytes()), []).append(lo)
        parts, use, found = [t[v].to_numpy() for v in names], [], [[] for _ in names]
        for (number_, box, place_), starts in alike.items():
            place = np.frombuffer(place_, np.int64)
            n = len(place)
            most = max(1, HELD // n)
            mine = np.arange(n)[number_ * most : (number_ + 1) * most]
            there = np.zeros(np.prod(box), bool)
            there[place] = True
            grids = max(1, HELD // (len(there) * len(mine)))
            for lo in range(0, len(starts), grids):
                rows_ = np.array(starts[lo : lo + grids])[:, None] + np.arange(n)
                got = slopes(there.reshape(box), place, mine, [v[rows_] for v in parts])
                if got is not None:
                    use.append(rows_[:, mine].ravel())
                    for kept, x in zip(found, got, strict=True):
                        kept.append(x.ravel())
        out = t.select([*keys, *axes]).take(pa.array(np.concatenate(use) if use else np.empty(0, np.int64)))
        for v, x in zip(names, found, strict=True):
            out = out.append_column(v, pa.array(np.concatenate(x) if x else [], pa.float64()))
        return out

    def run(batches):
        for t, ends in runs(batches):
            yield from whole(t, ends).to_batches()

    kinds = schema_of(nodes, [*keys, *axes]) + ", " + ", ".join(f"{v} double" for v in names)
    return rows.repartition("_g").sortWithinPartitions("_g", *keys, "_block", *axes).mapInArrow(run, kinds)


def _copies(nodes: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    which = F.explode(F.array(*[F.struct(F.lit(v).alias("part"), F.lit(s).alias("sign")) for v in parts_of(axes) for s in (1.0, -1.0)])).alias("_w")
    return nodes.select(*keys, *[F.col(a).alias(f"_c{a}") for a in axes], which).select(*keys, *[f"_c{a}" for a in axes], F.col("_w.part").alias("_part"), F.col("_w.sign").alias("_sign"))
