"""Similarity of consecutive images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import SQL_2D, img2d


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = img2d(spark, sf_dir)
    b = img2d(spark, sf_dir).select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("value").alias("w"))
    d = F.col("value") - F.col("w")
    return a.join(b, ["image_id", "x", "y"]).groupBy("image_id").agg(F.round(F.sum(d * d), 6).alias("ssd"), F.round(F.corr("value", "w"), 6).alias("ncc"), F.round(F.avg(F.abs(d)), 6).alias("mad"))


QUERIES = [(
    "w_similarity_pairs",
    _pairs,
    f"WITH {SQL_2D} SELECT a.image_id, round(sum((a.value - b.value) * (a.value - b.value)), 6) AS ssd, round(corr(a.value, b.value), 6) AS ncc, round(avg(abs(a.value - b.value)), 6) AS mad FROM img2d a JOIN img2d b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.image_id",
)]
