"""Voxel-wise operators: arithmetic, rescaling, thresholds, masks and conversions.

An image is a frame with key columns (say image_id), axes (x, y, and z or t as needed) and `value`. Functions take
the key columns and axes from the caller, add no shuffle of their own unless two images meet or a range over the whole
image is needed, and treat NaN as a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import INF, NAN, clamp, half_away, safe_div, safe_ln, truncated, whole
from .measures import ranges
from .order import order_statistics

OPERATIONS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": safe_div}

#: Ranges of element types (fixed values).
TYPE_RANGES = {"uint8": (0, 255), "int8": (-128, 127), "int16": (-32768, 32767), "uint16": (0, 65535), "int32": (-2147483648, 2147483647), "uint32": (0, 4294967295)}


def image_with_image(a: DataFrame, b: DataFrame, on: list[str], op: str, slope_a=1.0, inter_a=0.0, slope_b=1.0, inter_b=0.0) -> DataFrame:
    """Each voxel of a combined with that of b; both are scaled first and the result is stored in a's scaling."""
    other = b.select(*on, F.col("value").alias("_w"))
    v = OPERATIONS[op](F.col("value") * slope_a + inter_a, F.col("_w") * slope_b + inter_b)
    return a.join(other, on).withColumn("value", (v - inter_a) / slope_a).drop("_w")


def image_with_value(a: DataFrame, op: str, number: float, slope=1.0, inter=0.0) -> DataFrame:
    v = OPERATIONS[op](F.col("value") * slope + inter, F.lit(float(number)))
    return a.withColumn("value", (v - inter) / slope)


def rescale(a: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Each volume's range moved to [low, high]; NaN is left out of the range and stays."""
    lo, hi = F.col("_lo_value"), F.col("_hi_value")
    return ranges(a, keys, ["value"]).withColumn("value", safe_div(F.col("value") - lo, hi - lo) * (high - low) + low).select(a.columns)


def apply_scaling(a: DataFrame, slope: float, inter: float) -> DataFrame:
    """Values as the header's scaling means them; a slope of 0 counts as 1."""
    return a.withColumn("value", F.col("value") * (slope or 1.0) + inter)


def threshold(a: DataFrame, low: float, high: float) -> DataFrame:
    return a.withColumn("value", clamp(F.col("value"), low, high))


def cast_type(a: DataFrame, kind: str) -> DataFrame:
    """Element type changed: cut toward zero within the type's range; float types stay as they are."""
    if kind in ("float32", "float64"):
        return a.withColumn("value", F.col("value").cast("float" if kind == "float32" else "double").cast("double"))
    return a.withColumn("value", truncated(F.col("value"), *TYPE_RANGES[kind]).cast("double"))


def cut_fractions(a: DataFrame) -> DataFrame:
    """Values cut toward zero, without the range of an element type."""
    return a.withColumn("value", whole(F.col("value")))


def binarise(a: DataFrame) -> DataFrame:
    """1 where the value isn't 0 (NaN: 1)."""
    return a.withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.lit(1.0)))


def binarise_at(a: DataFrame, limit: float) -> DataFrame:
    """0 below the limit, else 1 (NaN: 1)."""
    return a.withColumn("value", F.when(~F.isnan("value") & (F.col("value") < limit), F.lit(0.0)).otherwise(F.lit(1.0)))


def mask_of(a: DataFrame) -> DataFrame:
    return a.withColumn("active", F.col("value") != 0).drop("value")


def within_mask(a: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    """Voxels that the mask holds active: a semi join."""
    return a.join(mask.where("active").select(*on), on, "left_semi")


def nan_outside(a: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    joined = a.join(mask.select(*on, "active"), on, "left")
    return joined.withColumn("value", F.when(F.coalesce("active", F.lit(False)), F.col("value")).otherwise(F.lit(NAN))).drop("active")


def within_thresholds(mask: DataFrame, image: DataFrame, on: list[str], low: float, high: float) -> DataFrame:
    """Mask voxels where the image lies between both thresholds; NaN doesn't."""
    good = image.where(~F.isnan("value") & F.col("value").between(low, high)).select(*on)
    return mask.join(good, on, "left_semi")


def drop_nan_from_mask(mask: DataFrame, image: DataFrame, on: list[str]) -> DataFrame:
    """Mask voxels of which no time point is NaN."""
    bad = image.where(F.isnan("value")).select(*on).distinct()
    return mask.join(bad, on, "left_anti")


def replace_nan_inf(a: DataFrame, by: float, compat: bool = False) -> DataFrame:
    """NaN and infinities replaced; compat leaves negative infinity."""
    v = F.col("value")
    bad = F.isnan(v) | (v == INF)
    return a.withColumn("value", F.when(bad if compat else bad | (v == -INF), F.lit(float(by))).otherwise(v))


def robust_normalise(a: DataFrame, keys: list[str], low: float = 0.03, high: float = 0.97) -> DataFrame:
    """Less the value at the sorted place floor(low n), over the distance to that at floor(high n), per image."""
    found = order_statistics(a, keys, "value", {"_lo": lambda n: F.floor(n * low), "_hi": lambda n: F.floor(n * high)})
    lo, hi = F.col("_lo"), F.col("_hi")
    return a.join(found, keys).withColumn("value", safe_div(F.col("value") - lo, hi - lo)).select(a.columns)


def log_image(a: DataFrame) -> DataFrame:
    return a.withColumn("value", safe_ln(F.col("value")))


def channels_to_rgb(a: DataFrame, keys: list[str]) -> DataFrame:
    """Time points 0, 1, 2 as red, green, blue, each rescaled to 0..255 over the whole series and rounded."""
    lo, hi = F.col("_lo_value"), F.col("_hi_value")
    level = half_away(safe_div(F.col("value") - lo, hi - lo) * 255).cast("int")
    pick = lambda t: F.coalesce(F.max(F.when(F.col("t") == t, F.col("_v"))), F.lit(0))
    return ranges(a, keys[:1], ["value"]).withColumn("_v", level).groupBy(*keys).agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def signed_to_rgb(a: DataFrame, keys: list[str]) -> DataFrame:
    """Positive values in green, negative ones in red, as shares of the largest magnitude."""
    most = F.greatest(F.abs("_lo_value"), F.abs("_hi_value"))
    level = half_away(safe_div(F.abs(F.col("value")), most) * 255).cast("int")
    return ranges(a, keys, ["value"]).withColumn("r", F.when(F.col("value") < 0, level).otherwise(F.lit(0))).withColumn("g", F.when(F.col("value") > 0, level).otherwise(F.lit(0))).withColumn("b", F.lit(0)).drop("value", "_lo_value", "_hi_value")


def world(m: list[float], axes=("x", "y", "z")) -> list[Column]:
    """Position of a voxel by a row-major 4 by 4 matrix; an axis that is None counts as 0."""
    c = [F.col(a) if a else F.lit(0.0) for a in axes]
    return [m[4 * r] * c[0] + m[4 * r + 1] * c[1] + m[4 * r + 2] * c[2] + m[4 * r + 3] for r in range(3)]


def displacement_of(field: DataFrame, m: list[float], axes=("x", "y", "z")) -> DataFrame:
    """Deformation field (vx, vy, vz: positions) to displacements."""
    w = world(m, axes)
    return field.withColumns({v: F.col(v) - w[k] for k, v in enumerate(("vx", "vy", "vz")) if v in field.columns})


def deformation_of(field: DataFrame, m: list[float], axes=("x", "y", "z")) -> DataFrame:
    w = world(m, axes)
    return field.withColumns({v: F.col(v) + w[k] for k, v in enumerate(("vx", "vy", "vz")) if v in field.columns})


def zero_components(field: DataFrame, names: list[str]) -> DataFrame:
    return field.withColumns({n: F.lit(0.0) for n in names})


def grid(spark: SparkSession, nx: int, ny: int, nz: int = 1) -> DataFrame:
    """All voxels of a grid, x fastest."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z"))


def identity_field(spark: SparkSession, dim: tuple[int, int, int], m: list[float]) -> DataFrame:
    w = world(m)
    return grid(spark, *dim).select("x", "y", "z", *[w[k].cast("double").alias(v) for k, v in enumerate(("vx", "vy", "vz"))])


def checker_lines(spark: SparkSession, dim: tuple[int, int, int], every: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """1 on every n-th plane of the given axes, else 0: the pattern that shows a deformation."""
    on = F.lit(False)
    for a in axes:
        on = on | (F.col(a) % every == 0)
    return grid(spark, *dim).withColumn("value", F.when(on, F.lit(1.0)).otherwise(F.lit(0.0)))
