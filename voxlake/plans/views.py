"""Image views over the supplied tables: each embedding of 64 values is read as a small image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, value: 8 by 8 images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return e.select("image_id", (F.col("p") % 8).alias("x"), F.expr("p div 8").cast("int").alias("y"), F.col("v").cast("double").alias("value"))


def img3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, z, value: 4 by 4 by 4 images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return e.select("image_id", (F.col("p") % 4).alias("x"), (F.expr("p div 4").cast("int") % 4).alias("y"), F.expr("p div 16").cast("int").alias("z"), F.col("v").cast("double").alias("value"))


def img4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, x, y, value: four consecutive images are the time points of a series."""
    return img2d(spark, sf_dir).select(F.expr("image_id div 4").alias("series_id"), (F.col("image_id") % 4).cast("int").alias("t"), "x", "y", "value")


SQL_2D = "img2d AS (SELECT vec_id AS image_id, CAST((p - 1) % 8 AS INT) AS x, CAST((p - 1) // 8 AS INT) AS y, CAST(embedding[p] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"
SQL_3D = "img3d AS (SELECT vec_id AS image_id, CAST((p - 1) % 4 AS INT) AS x, CAST((p - 1) // 4 % 4 AS INT) AS y, CAST((p - 1) // 16 AS INT) AS z, CAST(embedding[p] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"
SQL_4D = SQL_2D + ", img4d AS (SELECT image_id // 4 AS series_id, CAST(image_id % 4 AS INT) AS t, x, y, value FROM img2d)"
