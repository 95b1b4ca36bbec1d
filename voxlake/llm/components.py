"""Connected components of a graph held as a DataFrame, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_path, table_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, files: int | None = None) -> DataFrame:
    """node, root: the smallest node that each node with an edge can reach. No edges: no rows.

    Each round is written to the shared folder, so a lost executor costs one round at most, and the round before
    is deleted. Rounds grow with the logarithm of the longest chain. files: as for materialise().
    """
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges", files)
    digest = None
    while True:
        new = materialise(_small_star(_large_star(now)), "edges", files)
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (old := table_path(now)) and seen != digest:
            remove_path(new.sparkSession, old)
        if seen == digest:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, digest = new, seen
