"""Similarity measures and image statistics as grouped aggregates.

A pair of images is one frame with `value` (reference) and `w` (warped), joined on their axes by the caller. Keys name
what is compared (say image_id and t). Undefined pairs (NaN in either) don't count unless said otherwise. All sums
are combined on the map side, so a pair of any size moves one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import b_spline, known, safe_div, valid


def defined(pair: DataFrame) -> DataFrame:
    return pair.where(valid("value") & valid("w"))


def ssd(pair: DataFrame, keys: list[str], weight: Column | None = None, factor: float = 1.0) -> DataFrame:
    """Negative weighted mean of squared differences; weight: a Jacobian determinant or local weight, else 1."""
    m = weight if weight is not None else F.lit(1.0)
    return defined(pair).groupBy(*keys).agg((-factor * safe_div(F.sum((F.col("value") - F.col("w")) * (F.col("value") - F.col("w")) * m), F.sum(m))).alias("measure"))


def ranges(a: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """a with _lo_<column> and _hi_<column>, the range of each key; NaN doesn't count.

    The ranges are one row a key, combined on the map side, and joined back by key: no task gets a whole image, and
    where the ranges are small Spark broadcasts them.
    """
    found = a.groupBy(*keys).agg(*[f(known(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    return a.join(found, keys)


def jointly_normalised(pair: DataFrame, keys: list[str]) -> DataFrame:
    """Both images moved to [0, 1] by the range that they share."""
    lo, hi = F.least("_lo_value", "_lo_w"), F.greatest("_hi_value", "_hi_w")
    return ranges(pair, keys, ["value", "w"]).withColumns({c: safe_div(F.col(c) - lo, hi - lo) for c in ("value", "w")}).select(pair.columns)


def in_bins(pair: DataFrame, keys: list[str], bins: int = 68) -> DataFrame:
    """Each image rescaled to [2, bins - 3], as joint histograms ask for."""
    out = {c: safe_div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * (bins - 5) + 2 for c in ("value", "w")}
    return ranges(pair, keys, ["value", "w"]).withColumns(out).select(pair.columns)


def joint_histogram(pair: DataFrame, keys: list[str], bins: int = 68, exact: bool = False) -> DataFrame:
    """keys, r, f, h: counts of bin pairs, spread by a cubic B-spline.

    exact spreads every voxel over four by four bins. Otherwise whole bins are counted first and the few counted rows
    are smoothed with [1/6, 2/3, 1/6] along each axis: the same work for images of any size after one map-side count.
    """
    here = defined(pair)
    if exact:
        taps = F.explode(F.sequence(F.lit(-1), F.lit(2)))
        spread = here.withColumn("_a", taps).withColumn("_b", F.explode(F.sequence(F.lit(-1), F.lit(2))))
        r, f = F.floor(F.col("value")) + F.col("_a"), F.floor(F.col("w")) + F.col("_b")
        rows = spread.select(*keys, r.cast("int").alias("r"), f.cast("int").alias("f"), (b_spline(F.col("value") - r) * b_spline(F.col("w") - f)).alias("h"))
        return rows.where(F.col("r").between(0, bins - 1) & F.col("f").between(0, bins - 1)).groupBy(*keys, "r", "f").agg(F.sum("h").alias("h"))
    counted = here.select(*keys, F.floor("value").cast("int").alias("r"), F.floor("w").cast("int").alias("f")).where(F.col("r").between(0, bins - 1) & F.col("f").between(0, bins - 1)).groupBy(*keys, "r", "f").agg(F.count(F.lit(1)).cast("double").alias("h"))
    for axis in ("r", "f"):
        part = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k")) for d, k in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6))])).alias("p")
        moved = counted.select("*", part).withColumn(axis, F.col(axis) + F.col("p.d")).withColumn("h", F.col("h") * F.col("p.k")).drop("p")
        counted = moved.where(F.col(axis).between(0, bins - 1)).groupBy(*keys, "r", "f").agg(F.sum("h").alias("h"))
    return counted


def nmi_of(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hr, hf, hrf (entropies) and measure = (hr + hf) / hrf."""
    total = F.sum("h").over(W.partitionBy(*keys))
    p = histogram.where("h > 0").withColumn("p", F.col("h") / total)
    entropy = lambda c: -F.sum(F.col(c) * F.ln(c))
    side = lambda axis, name: p.groupBy(*keys, axis).agg(F.sum("p").alias("q")).groupBy(*keys).agg(entropy("q").alias(name))
    return p.groupBy(*keys).agg(entropy("p").alias("hrf")).join(side("r", "hr"), keys).join(side("f", "hf"), keys).withColumn("measure", safe_div(F.col("hr") + F.col("hf"), F.col("hrf")))


def nmi(pair: DataFrame, keys: list[str], bins: int = 68, exact: bool = False) -> DataFrame:
    return nmi_of(joint_histogram(in_bins(pair, keys, bins), keys, bins, exact), keys)


def kld(pair: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Negative mean of (r + e) ln((r + e) / (w + e)); terms that aren't finite don't count."""
    e, m = 1e-16, weight if weight is not None else F.lit(1.0)
    term = (F.col("value") + e) * F.ln(F.when((F.col("w") + e != 0) & (F.try_divide(F.col("value") + e, F.col("w") + e) > 0), F.try_divide(F.col("value") + e, F.col("w") + e)))
    rows = defined(pair).withColumn("_t", term).withColumn("_m", m).where(valid("_t") & (F.abs("_t") < float("inf")))
    return rows.groupBy(*keys).agg((-safe_div(F.sum(F.col("_t") * F.col("_m")), F.sum("_m"))).alias("measure"))


def ncc(pair: DataFrame, keys: list[str]) -> DataFrame:
    return defined(pair).groupBy(*keys).agg(F.corr("value", "w").alias("measure"))


def rms(pair: DataFrame, keys: list[str], point: list[str]) -> DataFrame:
    """Sum over points of the length of the difference vector, over all points; points with a NaN add nothing."""
    per = pair.groupBy(*keys, *point).agg(F.sqrt(F.sum((F.col("value") - F.col("w")) * (F.col("value") - F.col("w")))).alias("d"))
    return per.groupBy(*keys).agg((F.sum(F.coalesce(known("d"), F.lit(0.0))) / F.count(F.lit(1))).alias("measure"))


def dti_distance(pair: DataFrame, keys: list[str]) -> DataFrame:
    """Negative mean tensor distance; channels 0..5 of each image are xx, xy, yy, xz, yz, zz in columns r0..r5, w0..w5."""
    d = [F.col(f"r{k}") - F.col(f"w{k}") for k in range(6)]
    xx, xy, yy, xz, yz, zz = d
    term = 2 / 3 * (xx * xx + yy * yy + zz * zz) + 2.0 * (xy * xy + xz * xz + yz * yz) - 2 / 3 * (xx * yy + xx * zz + yy * zz)
    return pair.groupBy(*keys).agg((-F.sum(known("_d")) / F.count(known("_d"))).alias("measure")) if "_d" in pair.columns else dti_distance(pair.withColumn("_d", term), keys)


def statistics(a: DataFrame, keys: list[str], slope: float = 1.0, inter: float = 0.0) -> DataFrame:
    """min, max, mean and population deviation of the scaled values; NaN doesn't count."""
    v = known(F.col("value") * slope + inter)
    return a.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def longest(field: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Length of the longest vector over the chosen components."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p) * F.col(p)
    return field.groupBy(*keys).agg(F.max(F.sqrt(total)).alias("length"))


def centre_of_mass(a: DataFrame, keys: list[str], m: list[float], axes=("x", "y", None)) -> DataFrame:
    """Mean position weighted by intensity, in world space."""
    v = known("value")
    at = [safe_div(F.sum(F.col(x) * v), F.sum(v)) if x else F.lit(0.0) for x in axes]
    c = a.groupBy(*keys).agg(*[p.alias(f"_{k}") for k, p in enumerate(at)])
    w = [m[4 * r] * F.col("_0") + m[4 * r + 1] * F.col("_1") + m[4 * r + 2] * F.col("_2") + m[4 * r + 3] for r in range(3)]
    return c.select(*keys, *[w[k].alias(n) for k, n in enumerate(("cx", "cy", "cz"))])


def block_variance(a: DataFrame, keys: list[str], axes: list[str], side: int = 4) -> DataFrame:
    """keys, b<axis>, n, mean, variance of blocks; usable if over half of a block's voxels are defined and vary."""
    names = [f"b{x}" for x in axes]
    v = known("value")
    got = a.withColumns({n: F.floor(F.col(x) / side).cast("int") for n, x in zip(names, axes, strict=True)}).groupBy(*keys, *names).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))
    return got.withColumn("usable", (F.col("n") > side ** len(axes) // 2) & (F.col("variance") > 0))


def nan_average(a: DataFrame, axes: list[str]) -> DataFrame:
    """Mean over images at each voxel without NaN; NaN where no image has a value."""
    return a.groupBy(*axes).agg(F.coalesce(F.avg(known("value")), F.lit(float("nan"))).alias("value"))


def time_covariance(a: DataFrame, keys: list[str], voxel: list[str], t: str = "t") -> DataFrame:
    """keys, t, u, cov: population covariance of time points over voxels, by sums of products of voxels' series."""
    b = a.select(*keys, *voxel, F.col(t).alias("u"), F.col("value").alias("_w"))
    return a.join(b, [*keys, *voxel]).groupBy(*keys, t, "u").agg(F.covar_pop("value", "_w").alias("cov"))


def weighted_sum(parts: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Several measures of the same keys added up with their weights."""
    total = None
    for df, weight in parts:
        one = df.select(*keys, (F.col("measure") * weight).alias("measure"))
        total = one if total is None else total.union(one)
    return total.groupBy(*keys).agg(F.sum("measure").alias("measure"))


def both_ways(forward: DataFrame, backward: DataFrame, keys: list[str]) -> DataFrame:
    """Measure of a symmetric comparison: that in the reference's space and that in the floating image's, added."""
    return weighted_sum([(forward, 1.0), (backward, 1.0)], keys)


def descriptor_measure(pair: DataFrame, keys: list[str], axes: list[str], context: bool = False) -> DataFrame:
    """Negative mean of squared differences of self-similarity descriptors, added over their channels.

    Voxels that are NaN in either image count in neither; the images must be dense.
    """
    from . import stencil

    describe = stencil.mind_ssc if context else stencil.mind
    sides = [describe(pair.select(*keys, *axes, F.col(c).alias("value")), keys, axes) for c in ("value", "w")]
    channels = [c for c in sides[0].columns if c not in (*keys, *axes)]
    other = sides[1].select(*keys, *axes, *[F.col(c).alias(f"_{c}") for c in channels])
    total = F.lit(0.0)
    for c in channels:
        total = total + (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))
    return sides[0].join(other, [*keys, *axes]).groupBy(*keys).agg((-F.avg(known(total))).alias("measure"))


def _lncc(pair: DataFrame, keys: list[str], axes: list[str], **options) -> DataFrame:
    from . import stencil

    return stencil.lncc(pair, keys, axes, **options)


#: Measures by the name that a user asks for, all of (pair, keys, axes) and their own options.
MEASURES = {
    "ssd": lambda pair, keys, axes, **o: ssd(pair, keys, **o),
    "ncc": lambda pair, keys, axes, **o: ncc(pair, keys, **o),
    "nmi": lambda pair, keys, axes, **o: nmi(pair, keys, **o),
    "kld": lambda pair, keys, axes, **o: kld(pair, keys, **o),
    "lncc": _lncc,
    "dti": lambda pair, keys, axes, **o: dti_distance(pair, keys, **o),
    "mind": lambda pair, keys, axes, **o: descriptor_measure(pair, keys, axes, **o),
    "mindssc": lambda pair, keys, axes, **o: descriptor_measure(pair, keys, axes, context=True, **o),
}


def measure(name: str, pair: DataFrame, keys: list[str], axes: list[str], **options) -> DataFrame:
    """keys, measure: any of MEASURES by its name."""
    if name not in MEASURES:
        raise ValueError(f"measures are {', '.join(MEASURES)}")
    return MEASURES[name](pair, keys, axes, **options)


def active_times(a: DataFrame, weights: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Time points whose weight is above 0. weights: keys, t, weight."""
    return a.join(weights.where(F.col("weight") > 0).select(*keys, t), [*keys, t], "left_semi")


def mask_centres(mask: DataFrame, keys: list[str], m: list[float], axes=("x", "y", None)) -> DataFrame:
    """keys, cx, cy, cz: mean position of a mask's active voxels in world space."""
    return centre_of_mass(mask.where("active").withColumn("value", F.lit(1.0)), keys, m, axes)


def centre_shift(reference: DataFrame, floating: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tx, ty, tz: the shift that brings the reference's centre (cx, cy, cz) onto the floating image's."""
    other = floating.select(*keys, *[F.col(f"c{a}").alias(f"_c{a}") for a in "xyz"])
    return reference.join(other, keys).select(*keys, *[(F.col(f"_c{a}") - F.col(f"c{a}")).alias(f"t{a}") for a in "xyz"])


def mask_shift(reference: DataFrame, floating: DataFrame, keys: list[str], m: list[float], axes=("x", "y", None)) -> DataFrame:
    """keys, tx, ty, tz: the shift between the centres of two masks' active voxels, in world space.

    Voxel centres are subtracted before the matrix turns the difference, so that its shift and the images' size don't
    cost digits.
    """
    centres = lambda mask, tag: mask.where("active").groupBy(*keys).agg(*[(F.avg(a) if a else F.max(F.lit(0.0))).alias(f"_{tag}{k}") for k, a in enumerate(axes)])
    both = centres(reference, "r").join(centres(floating, "f"), keys)
    moved = [F.col(f"_f{k}") - F.col(f"_r{k}") for k in range(3)]
    rows = [sum((m[4 * r + k] * moved[k] for k in range(1, 3)), m[4 * r] * moved[0]) for r in range(3)]
    return both.select(*keys, *[c.alias(f"t{a}") for c, a in zip(rows, "xyz", strict=True)])


def painted_blocks(a: DataFrame, keys: list[str], axes: list[str], side: int = 4) -> DataFrame:
    """Image of the variance of the block that each voxel lies in; -1 where the block isn't usable."""
    names = [f"b{x}" for x in axes]
    found = block_variance(a, keys, axes, side).select(*keys, *names, F.when(F.col("usable"), F.col("variance")).otherwise(F.lit(-1.0)).alias("_v"))
    at = a.withColumns({n: F.floor(F.col(x) / side).cast("int") for n, x in zip(names, axes, strict=True)})
    return at.join(found, [*keys, *names]).withColumn("value", F.col("_v")).select(a.columns)
