"""Reading and writing images, matrices and landmarks.

Voxels come from the data source of volumes.py as rows, headers from the first bytes of each file, and encoded images go
to a shared store file by file.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import codecs, store
from .meta import ImageMeta
from .volumes import KINDS, VOXELS, Voxels, header_bytes, kind_of

HEADERS = "image_id string, dim array<int>, pixdim array<double>, datatype string, scl_slope double, scl_inter double, world array<double>, intent string, intent_p array<double>"


def is_image_name(name: str) -> bool:
    return any(e in name.lower() for ends in KINDS.values() for e in ends)


def decode(name: str, data: bytes, header_only: bool = False) -> tuple[ImageMeta, np.ndarray | None]:
    kind = kind_of(name)
    if kind == "png":
        v = codecs.read_png(data)
        return ImageMeta("", (*v.shape, 1, 1, 1, 1, 1), (1.0,) * 7, "uint8", 1.0, 0.0, 0, 1), v.reshape(*v.shape, 1, 1, 1, 1, 1)
    return codecs.read_nrrd(data) if kind == "nrrd" else codecs.read_nifti(data, header_only=header_only)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header of each image: of NIfTI and Analyze files only the header is read, of others the file."""

    def head(path: str) -> ImageMeta:
        if kind_of(path) == "nifti":
            return codecs.read_nifti(header_bytes(path), header_only=True)[0]
        with store.stream(path, False) as f:
            return decode(path, f.read(), True)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                m = head(p)
                rows.append((p, list(m.dim), list(map(float, m.pixdim)), m.datatype, m.scl_slope, m.scl_inter, m.world().ravel().tolist(), m.intent, list(map(float, m.intent_p))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADERS.split(", ")])

    names = spark.read.format("binaryFile").load(path).select("path")  # names alone: the content isn't read
    return names.where(~F.lower("path").rlike(r"\.img(\.gz)?$")).mapInPandas(run, HEADERS)


def read_voxels(spark: SparkSession, path: str, scaled: bool = True, slab: int | None = None) -> DataFrame:
    """image_id (the address), x, y, z, t, u, value of every voxel; scaled: with the header's slope and intercept.

    slab: bytes of voxels for a task. Filters on image_id, z, t and u reach the files (volumes.py).
    """
    spark.dataSource.register(Voxels)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("voxels").option("path", path).option("scaled", str(scaled).lower())
    return (source.option("slab", slab) if slab else source).load()


def encode_images(voxels: DataFrame, meta: ImageMeta, kind: str = "nifti") -> DataFrame:
    """image_id, content: every image of a voxel frame encoded as a file with this header. An image fits a task."""
    dim = meta.dim

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full(dim, np.nan)
        v[pdf["x"], pdf["y"], pdf["z"], pdf["t"], pdf["u"], 0, 0] = pdf["value"]
        if kind == "png":
            data = codecs.write_png(v[:, :, 0, 0, 0, 0, 0])
        elif kind == "nrrd":
            data = codecs.write_nrrd(meta, v)
        else:
            data = codecs.write_nifti(meta, v if meta.datatype.startswith("float") else np.nan_to_num(v), True)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "content": [data]})

    return voxels.groupBy("image_id").applyInPandas(run, "image_id string, content binary")


class ImageFiles(DataSource):
    """Sink for encode_images(): each row's content becomes the file named by its image_id in the folder `path`.

    Use: encoded.write.format("images").option("path", folder).mode("append").save(). The folder is an address of a shared
    store, or a path that all executors see. A file is written under another name and moved when whole, so a task that is
    run again replaces it.
    """

    @classmethod
    def name(cls) -> str:
        return "images"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ImageWriter(self.options["path"])


class _ImageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        for r in rows:
            to = posixpath.join(self.path, safe_name(r["image_id"]))
            store.replaced(to, r["content"], posixpath.join(self.path, f"_{uuid.uuid4().hex}.part"))
        return WriterCommitMessage()


def write_images(encoded: DataFrame, path: str) -> None:
    """Files of encode_images() in a shared folder, named by image_id (other signs than letters, digits, dots and dashes
    become underscores)."""
    encoded.sparkSession.dataSource.register(ImageFiles)
    encoded.select("image_id", "content").write.format("images").option("path", path).mode("append").save()


def safe_name(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name)


def split_times(voxels: DataFrame, path: str) -> None:
    """A 4D image written as one Parquet folder for each time point."""
    voxels.write.partitionBy("t").parquet(path)


def stack_times(parts: list[DataFrame]) -> DataFrame:
    out = None
    for t, p in enumerate(parts):
        one = p.drop("t").withColumn("t", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """Rows of numbers in a small text file, as a matrix."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    return np.array([[float(x) for x in line.split()] for line in "\n".join(lines).splitlines() if line.strip()])


def matrix_text(m: np.ndarray) -> str:
    return "".join(" ".join(f"{x:.7g}" for x in row) + "\n" for row in np.asarray(m))


def read_landmarks(spark: SparkSession, path: str, d: int = 3) -> DataFrame:
    """line, px, py (and pz) of a text file with one point a line."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = [F.element_at(parts, k + 1).cast("double").alias(f"p{a}") for k, a in enumerate("xyz"[:d])]
    return spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("landmark"), *cols)


def rgb_channels(voxels: DataFrame) -> DataFrame:
    """Interleaved vector components as one row a voxel: u0, u1, ... ."""
    return voxels.groupBy("image_id", "x", "y", "z", "t").pivot("u").agg(F.first("value"))


def vector_rows(field: DataFrame, keys: list[str], axes: list[str], components: list[str]) -> DataFrame:
    """Components as rows: u (place of the component) and value for each voxel, as vector images are stored."""
    parts = F.array(*[F.struct(F.lit(k).alias("u"), F.col(c).cast("double").alias("value")) for k, c in enumerate(components)])
    return field.select(*keys, *axes, F.explode(parts).alias("_p")).select(*keys, *axes, "_p.u", "_p.value")


def vector_columns(rows: DataFrame, keys: list[str], axes: list[str], components: list[str]) -> DataFrame:
    """Rows of u and value as one column for each component."""
    return rows.groupBy(*keys, *axes).agg(*[F.max(F.when(F.col("u") == k, F.col("value"))).alias(c) for k, c in enumerate(components)])


def reoriented(voxels: DataFrame, new: dict[str, str], dim: dict[str, int]) -> DataFrame:
    """Axes exchanged and turned: new names for each axis the old one that it runs along, "-" for against it."""
    at = lambda old: F.lit(dim[old[1:]] - 1) - F.col(old[1:]) if old.startswith("-") else F.col(old)
    return voxels.withColumns({a: at(old).cast("int") for a, old in new.items()})


def reoriented_world(m: np.ndarray, new: dict[str, str], dim: dict[str, int]) -> np.ndarray:
    """Voxel-to-world matrix of the reoriented image: each voxel stays where it is."""
    axes, back = ["x", "y", "z"], np.zeros((4, 4))
    back[3, 3] = 1.0
    for k, a in enumerate(axes):
        old = new.get(a, a)
        row = axes.index(old.removeprefix("-"))
        back[row, k] = -1.0 if old.startswith("-") else 1.0
        back[row, 3] = dim[axes[row]] - 1 if old.startswith("-") else 0.0
    return np.asarray(m, float) @ back


def matrix_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns of a matrix in a text file; rows of differing length are an error."""
    lines = [len(r.value.split()) for r in spark.read.text(path).collect() if r.value.strip()]
    if len(set(lines)) > 1:
        raise ValueError("the rows of the matrix differ in length")
    return len(lines), lines[0] if lines else 0
