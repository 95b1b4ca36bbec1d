"""Transformations of any kind behind one name: made dense, composed, inverted and applied to landmarks.

Kinds are affine (a 4 by 4 matrix in voxels), grid (control grid), linear_grid (read straight between nodes), velocity
(control grid of displacements to be exponentiated), deformation, displacement, and flow (dense displacements to be
exponentiated).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import transform
from .inversion import inverse_field
from .regularise import linear_spline_field
from .transform import PARTS, parts_of

KINDS = ("affine", "grid", "linear_grid", "velocity", "deformation", "displacement", "flow")


@dataclass(frozen=True)
class Transformation:
    kind: str
    data: DataFrame | list[float]
    spacing: float = 1.0  # voxels between nodes
    squarings: int | None = None
    backward: bool = False  # of velocities: the inverse is meant

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kinds are {', '.join(KINDS)}")


def flow(t: Transformation, voxels: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Dense flow (displacements before exponentiation) of a velocity transformation; with its sign if it runs backward."""
    if t.kind not in ("velocity", "flow"):
        raise ValueError(f"a transformation of kind {t.kind} has no flow")
    out = t.data if t.kind == "flow" else transform.spline_field(voxels, t.data, keys, axes, t.spacing)
    return out.select(*keys, *axes, *[(F.col(v) * (-1.0 if t.backward else 1.0)).alias(v) for v in parts_of(axes)])


def deformation(t: Transformation, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> DataFrame:
    """Positions of the voxels (keys, axes) under the transformation."""
    if t.kind == "affine":
        return transform.affine_field(voxels, t.data, axes).select(*keys, *axes, *parts_of(axes))
    if t.kind == "grid":
        return transform.spline_field(voxels, t.data, keys, axes, t.spacing)
    if t.kind == "linear_grid":
        return linear_spline_field(voxels, t.data, keys, axes, t.spacing)
    if t.kind in ("velocity", "flow"):
        return transform.exponentiate(flow(t, voxels, keys, axes), keys, axes, dim, t.squarings)
    moved = {PARTS[a]: F.col(PARTS[a]) + (F.col(a) if t.kind == "displacement" else F.lit(0.0)) for a in axes}
    return t.data.select(*keys, *axes, *[c.alias(v) for v, c in moved.items()])


def displacement(t: Transformation, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> DataFrame:
    return deformation(t, voxels, keys, axes, dim).withColumns({PARTS[a]: F.col(PARTS[a]) - F.col(a) for a in axes})


def jacobian(t: Transformation, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> DataFrame:
    """j<component><axis>, det and log_det at the voxels for a transformation of any kind.

    Affines have their matrix everywhere, control grids the slopes of their lattice, dense fields forward differences, and
    velocities the product of the matrices of their squarings. log_det is NaN where the transformation folds.
    """
    if t.kind == "affine":
        row = {f"j{b}{a}": F.lit(float(t.data[4 * "xyz".index(b) + "xyz".index(a)])) for b in axes for a in axes}
        out = voxels.select(*keys, *axes).withColumns(row).withColumn("det", transform.determinant(axes))
    elif t.kind in ("grid", "linear_grid"):
        out = transform.spline_jacobian(voxels, t.data, keys, axes, t.spacing, "cubic" if t.kind == "grid" else "linear")
    elif t.kind in ("velocity", "flow"):
        out = transform.flow_jacobian(flow(t, voxels, keys, axes), keys, axes, dim, t.squarings)
    else:
        out = transform.field_jacobian(deformation(t, voxels, keys, axes, dim), keys, axes)
    return transform.log_determinant(out).select(*keys, *axes, *[f"j{b}{a}" for b in axes for a in axes], "det", "log_det")


def composed(second: Transformation, first: Transformation, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int]) -> Transformation:
    """second(first(x)) as a deformation. An affine second and two grids of one spacing are composed without sampling."""
    if second.kind == first.kind == "grid" and second.spacing == first.spacing:
        return replace(first, data=transform.compose_grids(second.data, first.data, keys, axes, first.spacing))
    inner = deformation(first, voxels, keys, axes, dim)
    if second.kind == "affine":
        return Transformation("deformation", transform.affine_after(inner, second.data, axes))
    return Transformation("deformation", transform.compose(deformation(second, voxels, keys, axes, dim), inner, keys, axes, dim))


def inverted(t: Transformation, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], rounds: int = 20) -> Transformation:
    """The inverse: of an affine its matrix, of velocities the same ones run backward, of all others a dense field."""
    if t.kind == "affine":
        import numpy as np

        return replace(t, data=np.linalg.inv(np.reshape(t.data, (4, 4))).ravel().tolist())
    if t.kind in ("velocity", "flow"):
        return replace(t, backward=not t.backward)
    return Transformation("deformation", inverse_field(deformation(t, voxels, keys, axes, dim), keys, axes, dim, rounds).drop("residual"))


def landmarks(t: Transformation, points: DataFrame, voxels: DataFrame, keys: list[str], axes: list[str], dim: dict[str, int], point: list[str]) -> DataFrame:
    """Positions of points p<axis>: by the matrix of an affine, else sampled linearly from the dense field."""
    if t.kind == "affine":
        at = points.select(*keys, *point, *[F.col(f"p{a}").alias(PARTS[a]) for a in axes])
        return transform.affine_after(at, t.data, axes)
    return transform.map_landmarks(points, deformation(t, voxels, keys, axes, dim), keys, axes, point)
