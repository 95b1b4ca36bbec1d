"""Registration: driver loops over the operators. One round is a handful of Spark jobs; only sums, matrices and scalar
measures reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import estimate, matrix, measures, penalty, regularise, resample, select, stencil, transform, voxel
from .lineage import cut


def _points(voxels: DataFrame, m: np.ndarray, axes: list[str]) -> DataFrame:
    moved = transform.affine_field(voxels, m.ravel().tolist(), axes)
    return moved.withColumns({f"p{a}": F.col(transform.PARTS[a]) for a in axes})


def warp(floating: DataFrame, voxels: DataFrame, m: np.ndarray, axes: list[str], order: int = 1, padding: float = float("nan")) -> DataFrame:
    """The floating image on the reference's voxels through an affine in voxel space."""
    return resample.resample(floating, _points(voxels, m, axes), [], axes, axes, order, padding)


def _round(reference: DataFrame, floating: DataFrame, m: np.ndarray, axes: list[str], rigid: bool, blocks: float, inliers: float, reach: int) -> np.ndarray:
    key = [F.lit(0).alias("image_id")]
    ref = reference.select(*key, *axes, "value")
    warped = cut(warp(floating, reference.select(*axes), m, axes).select(*key, *axes, "value"))
    chosen = select.top_blocks(ref, ["image_id"], axes, blocks)
    found = select.match_blocks(ref, warped, ["image_id"], axes, chosen, reach)
    to = transform.affine_field(found.select(*[(F.col(f"b{a}") * 4 + F.col(f"d{a}")).alias(a) for a in axes], *[(F.col(f"b{a}") * 4.0).alias(f"r{a}") for a in axes]), m.ravel().tolist(), axes)
    pairs = to.select(*[F.col(f"r{a}") for a in axes], *[F.col(transform.PARTS[a]).alias(f"w{a}") for a in axes])
    return estimate.trimmed_fit(pairs, len(axes), inliers, rigid)


def affine_registration(
    reference: DataFrame, floating: DataFrame, axes: list[str], dim: dict[str, int], levels: int = 2, rounds: int = 4, rigid_only: bool = False, symmetric: bool = False, blocks: float = 50, inliers: float = 50, reach: int = 3,
    reference_mask: DataFrame | None = None, floating_mask: DataFrame | None = None, thresholds: tuple[float, float] | None = None, centred: bool = False, start: np.ndarray | None = None,
) -> np.ndarray:
    """Affine from reference voxels to floating voxels by block matching and trimmed least squares, coarse to fine.

    Rigid rounds come first at the coarsest level, then affine ones. symmetric also matches backward and takes the
    log-Euclidean mean of both directions. Masks (axes, active) and thresholds (of the floating image's values) make all
    other voxels undefined, so that no block counts them. The search starts from the matrix `start`, or with centred from
    the shift between both images' centres: of their masks where both have one, else of their intensities.
    """
    m = np.eye(4) if start is None else np.asarray(start, float)
    if centred:
        pair = [(reference, reference_mask), (floating, floating_mask)]
        by_mask = all(mask is not None for _, mask in pair)
        identity, at = np.eye(4).ravel().tolist(), tuple(a if a in axes else None for a in "xyz")
        one = [(mask if by_mask else image).withColumn("k", F.lit(0)) for image, mask in pair]
        centres = [measures.mask_centres(x, ["k"], identity, at) if by_mask else measures.centre_of_mass(x, ["k"], identity, at) for x in one]
        shift = measures.centre_shift(*centres, ["k"]).first()
        m[:3, 3] = [shift.tx, shift.ty, shift.tz]
    if reference_mask is not None:
        reference = voxel.nan_outside(reference.select(*axes, "value"), reference_mask, axes)
    if floating_mask is not None:
        floating = voxel.nan_outside(floating.select(*axes, "value"), floating_mask, axes)
    if thresholds:
        floating = floating.withColumn("value", F.when(F.col("value").between(*thresholds), F.col("value")).otherwise(F.lit(float("nan"))))
    pyramid = lambda a: resample.pyramid(a.select(F.lit(0).alias("image_id"), *axes, "value"), ["image_id"], dim, levels, least=16)
    refs, flos = pyramid(reference), pyramid(floating)
    for level, ((r, size), (f, _)) in enumerate(zip(refs, flos, strict=True)):
        r, f = cut(r.drop("image_id")), cut(f.drop("image_id"))
        scale = np.diag([*[dim[a] / size[a] if a in dim else 1.0 for a in "xyz"], 1.0])
        m = np.linalg.inv(scale) @ m @ scale
        plan = [True] * rounds if rigid_only else ([True] * rounds if level == 0 else []) + [False] * rounds
        for rigid in plan:
            new = _round(r, f, m, axes, rigid, blocks, inliers, reach)
            if symmetric:
                back = _round(f, r, np.linalg.inv(m), axes, rigid, blocks, inliers, reach)
                new = matrix.mean([new, np.linalg.inv(back)])
            m = new
        m = scale @ m @ np.linalg.inv(scale)
    return m


def _slope(measure: str, pair: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """g<axis>: against the slope of a measure of a pair that carries the warped image's gradient s<axis>."""
    if measure == "nmi":
        binned = measures.in_bins(pair, keys)
        return estimate.nmi_gradient(binned, measures.joint_histogram(binned, keys), keys, axes, axes)
    if measure == "lncc":
        return estimate.lncc_gradient(pair, keys, axes)
    if measure == "kld":
        return estimate.kld_gradient(pair, keys, axes).withColumns({f"g{a}": -F.col(f"g{a}") for a in axes})
    if measure == "ssd":
        return estimate.ssd_gradient(pair, keys, axes)
    raise ValueError("registration is offered for ssd, nmi, kld and lncc")


def _energies(grid: DataFrame, axes: list[str], spacing: float, weights: dict[str, float]) -> float:
    """Weighted sum of the penalties of a grid (one key, k)."""
    fn = {
        "bending": lambda: transform.bending_energy(grid, ["k"], axes).first().energy,
        "linear": lambda: regularise.linear_energy(grid, ["k"], axes, spacing).first().energy,
        "jacobian": lambda: penalty.grid_penalty(grid, ["k"], axes, spacing).first().penalty,
    }
    return sum(w * fn[name]() for name, w in weights.items() if w)


def _energy_slope(grid: DataFrame, axes: list[str], spacing: float, weights: dict[str, float]) -> DataFrame | None:
    """Slope of _energies() for each node's components; None without penalties."""
    fn = {
        "bending": lambda: regularise.bending_gradient(grid, ["k"], axes),
        "linear": lambda: regularise.linear_gradient(grid, ["k"], axes, spacing),
        "jacobian": lambda: penalty.penalty_gradient(grid, ["k"], axes, spacing),
    }
    parts, total = transform.parts_of(axes), None
    for name, w in weights.items():
        if w:
            one = fn[name]().select("k", *axes, *[(F.col(v) * w).alias(v) for v in parts])
            total = one if total is None else total.union(one)
    return None if total is None else total.groupBy("k", *axes).agg(*[F.sum(v).alias(v) for v in parts])


def _node_gradient(dense: DataFrame, nodes: DataFrame, axes: list[str], spacing: float) -> DataFrame:
    """A voxel gradient (k, axes, components) brought to the nodes: convolved at their spacing and read there."""
    smooth = stencil.convolve_components(dense, ["k"], axes, {a: -spacing for a in axes}, transform.parts_of(axes), "cubic")
    return transform.to_nodes(smooth, nodes, ["k"], axes, spacing)


def spline_registration(reference: DataFrame, floating: DataFrame, axes: list[str], dim: dict[str, int], spacing: float = 5.0, rounds: int = 10, bending: float = 0.001, linear: float = 0.0, jacobian: float = 0.0, measure: str = "ssd", mask: DataFrame | None = None, levels: int = 1, trials: int = 6) -> tuple[DataFrame, float]:
    """Control grid that moves reference voxels onto the floating image, by conjugate gradient on a measure (ssd, nmi, kld
    or lncc) less weighted penalties: bending energy, linear energy and squared log Jacobians.

    levels: coarse to fine, with nodes `spacing` voxels apart at each level; mask (axes): the reference voxels that count.
    Returns the grid and the objective. Each step's image, gradient and grid stay distributed; the line search sees
    one number a trial.
    """
    one = F.lit(0).alias("k")
    image = lambda a: resample.pyramid(a.select(one, *axes, "value"), ["k"], dim, levels, least=16)
    masks = resample.mask_pyramid(mask.select(*axes), dim, levels, least=16) if mask is not None else [None] * levels
    nodes, before = None, dim
    for (r, size), (f, _), chosen in zip(image(reference), image(floating), masks, strict=True):
        first = transform.control_grid(reference.sparkSession, size, spacing)
        if nodes is not None:
            first = _refined(nodes, first, axes, spacing, {a: size[a] / before[a] for a in axes})
        r, f = cut(r.drop("k")), cut(f.drop("k"))
        nodes, best = _fit_grid(r if chosen is None else r.join(chosen, axes, "left_semi"), f, cut(first), axes, spacing, rounds, {"bending": bending, "linear": linear, "jacobian": jacobian}, measure, trials)
        before = size
    return nodes, best


def _refined(nodes: DataFrame, grid: DataFrame, axes: list[str], spacing: float, factor: dict[str, float]) -> DataFrame:
    """A coarser level's grid on the nodes of the next one: axes that became finer are refined, displacements grow with them."""
    finer = [a for a in axes if factor[a] > 1]
    moved = nodes.select(F.lit(0).alias("k"), *axes, *[((F.col(transform.PARTS[a]) - (F.col(a) - 1) * float(spacing)) * float(round(factor[a]))).alias(transform.PARTS[a]) for a in axes])
    dense = transform.refine_grid(moved, ["k"], axes, finer)
    have = dense.select(*axes, *[F.col(v).alias(f"_d{v}") for v in transform.parts_of(axes)])
    return grid.join(have, axes, "left").select(*axes, *[(F.col(v) + F.coalesce(f"_d{v}", F.lit(0.0))).alias(v) for v in transform.parts_of(axes)])


def _fit_grid(reference: DataFrame, floating: DataFrame, nodes: DataFrame, axes: list[str], spacing: float, rounds: int, penalties: dict[str, float], measure: str, trials: int) -> tuple[DataFrame, float]:
    parts, keyed = transform.parts_of(axes), lambda df: df.withColumn("k", F.lit(0))
    voxels, ref = reference.select(*axes), reference.select(*axes, "value")
    share = 1 - sum(penalties.values())

    def state(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = transform.spline_field(voxels, grid, [], axes, spacing).withColumns({f"p{a}": F.col(transform.PARTS[a]) for a in axes})
        return at, ref.join(resample.resample(floating, at, [], axes, axes, 1, float("nan")).withColumnRenamed("value", "w"), axes)

    def objective(grid: DataFrame) -> float:
        return share * measures.measure(measure, keyed(state(grid)[1]), ["k"], axes).first().measure - _energies(keyed(grid), axes, spacing, penalties)

    best, history = objective(nodes), None
    size = float(spacing)
    for _ in range(rounds):
        at, pair = state(nodes)
        slope = resample.image_gradient(floating, at, [], axes, axes).select(*axes, *[F.col(f"g{a}").alias(f"s{a}") for a in axes])
        g = _slope(measure, keyed(pair.join(slope, axes)), ["k"], axes)
        dense = g.select("k", *axes, *[(-F.col(f"g{a}") * share).alias(transform.PARTS[a]) for a in axes])
        grad = _node_gradient(dense, keyed(nodes), axes, spacing)
        against = _energy_slope(keyed(nodes), axes, spacing, penalties)
        if against is not None:
            grad = estimate.step(grad, against, ["k", *axes], parts, -1.0)
        on = ["k", *axes]
        grad = estimate.normalise_gradient(grad, ["k"], parts)
        if history is None:
            history = grad.select(*on, *[F.col(v).alias(f"p{v}") for v in parts], *[F.col(v).alias(f"h{v}") for v in parts])
        else:
            history = estimate.conjugate(grad, history, ["k"], on, parts)
        history = cut(history)
        move = history.select(*axes, *[F.col(f"h{v}").alias(v) for v in parts])
        done, value = estimate.line_search(lambda s, mv=move: objective(estimate.step(nodes, mv, axes, parts, s)), size, best, trials)
        if done == 0.0:
            break
        nodes, best, size = cut(estimate.step(nodes, move, axes, parts, done)), value, max(done, 0.1)
    return nodes, best


def velocity_registration(reference: DataFrame, floating: DataFrame, axes: list[str], dim: dict[str, int], spacing: float = 5.0, rounds: int = 10, bending: float = 0.001, measure: str = "ssd", squarings: int = 6, trials: int = 6) -> tuple[DataFrame, float]:
    """Velocity grid (displacements of nodes) whose exponential moves the reference onto the floating image, and whose
    negative moves the floating image back: both directions count the same.

    Each round takes the slope of both directions to the velocities, symmetrises it, and searches along it. Returns the
    grid and the objective.
    """
    parts, keyed = transform.parts_of(axes), lambda df: df.withColumn("k", F.lit(0))
    images = [keyed(x.select(*axes, "value")) for x in (reference, floating)]
    voxels, on = images[0].select("k", *axes), ["k", *axes]
    nodes = cut(keyed(transform.control_grid(reference.sparkSession, dim, spacing)).select(*on, *[F.lit(0.0).alias(v) for v in parts]))

    def fields(grid: DataFrame, side: int) -> list[DataFrame]:
        return transform.intermediate_fields(transform.spline_field(voxels, grid, ["k"], axes, spacing), ["k"], axes, dim, squarings, backward=side == 1)

    def pair(field: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
        at = field.withColumns({f"p{a}": F.col(transform.PARTS[a]) for a in axes})
        return at, images[side].join(resample.resample(images[1 - side], at, ["k"], axes, axes, 1, float("nan")).withColumnRenamed("value", "w"), on)

    def objective(grid: DataFrame) -> float:
        seen = [measures.measure(measure, pair(fields(grid, side)[-1], side)[1], ["k"], axes) for side in (0, 1)]
        return (1 - bending) * measures.both_ways(*seen, ["k"]).first().measure - 2 * bending * transform.bending_energy(grid, ["k"], axes).first().energy

    best, size = objective(nodes), float(spacing)
    for _ in range(rounds):
        slopes = []
        for side in (0, 1):
            steps = fields(nodes, side)
            at, seen = pair(steps[-1], side)
            slope = resample.image_gradient(images[1 - side], at, ["k"], axes, axes).select(*on, *[F.col(f"g{a}").alias(f"s{a}") for a in axes])
            g = _slope(measure, seen.join(slope, on), ["k"], axes)
            dense = g.select(*on, *[(-F.col(f"g{a}")).alias(transform.PARTS[a]) for a in axes])
            # a voxel outside the image says nothing
            dense = voxels.join(dense, on, "left").select(*on, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in parts])
            spread = estimate.exponentiated_gradient(dense, fields(nodes, 1 - side)[:-1], ["k"], axes)
            slopes.append(_node_gradient(spread, nodes, axes, spacing))
        move = cut(estimate.normalise_gradient(estimate.symmetrised(*slopes, on, parts)[0], ["k"], parts))
        done, value = estimate.line_search(lambda s, mv=move: objective(estimate.update_velocity(nodes, mv, on, parts, s)), size, best, trials)
        if done == 0.0:
            break
        nodes, best, size = cut(estimate.update_velocity(nodes, move, on, parts, done)), value, max(done, 0.1)
    return nodes.drop("k"), best


def groupwise(images: DataFrame, axes: list[str], dim: dict[str, int], passes: int = 3, **options) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """An atlas of a study's images: each pass registers every image to the mean (affine), takes the common part out of
    the matrices, and averages the images anew. images: image_id, axes, value; a study has tens of them.

    Returns the mean image and each image's matrix.
    """
    ids = [r.image_id for r in images.select("image_id").distinct().orderBy("image_id").collect()]
    mean, found = cut(measures.nan_average(images, axes)), {i: np.eye(4) for i in ids}
    for _ in range(passes):
        found = {i: affine_registration(mean, images.where(F.col("image_id") == i).drop("image_id"), axes, dim, **options) for i in ids}
        common = matrix.demean(list(found.values()))
        found = {i: m @ common for i, m in found.items()}
        mean = cut(average_images(images, found, axes))
    return mean, found


def pca_registration(series: DataFrame, axes: list[str], dim: dict[str, int], parts: int | None = None, **options) -> DataFrame:
    """A series of volumes (t, axes, value) aligned through its principal parts: with one part, then two and so on, each
    volume is registered (affine) to what these parts make of it, and read there."""
    times = [r.t for r in series.select("t").distinct().orderBy("t").collect()]
    now = series.select(F.lit(0).alias("series"), "t", *axes, "value")
    for count in range(1, (parts or len(times) - 1) + 1):
        cov = measures.time_covariance(now.where(~F.isnan("value")), ["series"], axes)
        target = cut(estimate.project_over_time(now.where(~F.isnan("value")), ["series"], axes, cov, count))
        out = None
        for t in times:
            volume = series.where(F.col("t") == t).select(*axes, "value")
            m = affine_registration(target.where(F.col("t") == t).select(*axes, "value"), volume, axes, dim, **options)
            one = warp(volume, volume.select(*axes), m, axes).select(F.lit(0).alias("series"), F.lit(t).alias("t"), *axes, "value")
            out = one if out is None else out.unionByName(one)
        now = cut(out)
    return now.drop("series")


def average_images(images: DataFrame, matrices: dict[int, np.ndarray] | DataFrame, axes: list[str]) -> DataFrame:
    """Mean of images (image_id, axes, value) after each is warped by its own matrix; NaN where none is defined.

    Matrices of many images come as a DataFrame: image_id and the first three rows as m0 to m11.
    """
    if isinstance(matrices, DataFrame):
        return _average(images, matrices, axes)
    spark = images.sparkSession
    rows = [(int(i), *[float(x) for x in np.asarray(m)[:3].ravel()]) for i, m in matrices.items()]
    table = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"m{k} double" for k in range(12)))
    return _average(images, table, axes)


def average_deformed(images: DataFrame, fields: DataFrame, axes: list[str], demean: bool = False) -> DataFrame:
    """Mean of images (image_id, axes, value), each read through its own dense field (image_id, axes, positions); demean:
    the fields' mean displacement is taken off first."""
    at = regularise.demeaned_fields(fields, axes) if demean else fields
    points = at.withColumns({f"p{a}": F.col(transform.PARTS[a]) for a in axes})
    return measures.nan_average(resample.resample(images, points, ["image_id"], axes, axes, 1, float("nan")), axes)


def _average(images: DataFrame, table: DataFrame, axes: list[str]) -> DataFrame:
    c = [F.col(a) if a in axes else F.lit(0.0) for a in "xyz"]
    at = {f"p{a}": F.col(f"m{4 * r}") * c[0] + F.col(f"m{4 * r + 1}") * c[1] + F.col(f"m{4 * r + 2}") * c[2] + F.col(f"m{4 * r + 3}") for r, a in enumerate("xyz") if a in axes}
    points = images.join(table, "image_id").withColumns(at)
    return measures.nan_average(resample.resample(images, points, ["image_id"], axes, axes, 1, float("nan")), axes)
