"""Work on generated grids of the sizes that image registration meets; timed by bench.py, read no table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures, resample, transform
from ..operators.voxel import grid

AXES = ["x", "y", "z"]


def image(spark: SparkSession, n: int, moved: float = 0.0) -> DataFrame:
    """A picture with structure at several scales, n voxels an axis."""
    x, y, z = (F.col(a) - moved for a in AXES)
    return grid(spark, n, n, n).select(F.lit(0).alias("k"), *AXES, (F.sin(x / 7.0) * 20 + F.cos(y / 5.0) * F.sin(z / 9.0) * 30 + F.sin(x * y / 53.0) * 5 + 60).alias("value"))


def resampled(spark: SparkSession, n: int, order: int) -> DataFrame:
    points = grid(spark, n, n, n).select(F.lit(0).alias("k"), *AXES, *[(F.col(a) * 0.97 + 0.4).alias(f"p{a}") for a in AXES])
    return resample.resample(image(spark, n), points, ["k"], AXES, AXES, order)


def similarity(spark: SparkSession, n: int) -> DataFrame:
    pair = image(spark, n).join(image(spark, n, 0.7).withColumnRenamed("value", "w"), ["k", *AXES])
    return measures.nmi(pair, ["k"])


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """A cubic control grid of nodes five voxels apart, read at every voxel."""
    nodes = transform.control_grid(spark, dict.fromkeys(AXES, n), 5.0).withColumn("vx", F.col("vx") + F.sin(F.col("y") * 1.0)).withColumn("k", F.lit(0))
    return transform.spline_field(grid(spark, n, n, n).select(F.lit(0).alias("k"), *AXES), nodes, ["k"], AXES, 5.0)


GRIDS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "grid_linear_64": lambda s: resampled(s, 64, 1),
    "grid_linear_128": lambda s: resampled(s, 128, 1),
    "grid_cubic_64": lambda s: resampled(s, 64, 3),
    "grid_nmi_64": lambda s: similarity(s, 64),
    "grid_spline_128": lambda s: lattice(s, 128),
}
