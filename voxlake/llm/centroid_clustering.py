"""Clustering around centroids in exact integers, with centroids ruled out by block norms.

Every vector is kept once as integers together with the squared norms of its segments (its compressed form). By the
Cauchy-Schwarz inequality on each segment, the inner product of a vector x and a centroid c is at most the sum over the
segments of |x_s| |c_s|, so |x|^2 + |c|^2 less twice that sum never exceeds their squared distance. All these lower bounds
are one matrix product of the compressed forms; only centroids whose bound doesn't exceed the least exact distance so far
get an exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, map_arrow, materialise, table

SEGMENT = 8
#: Components from this magnitude on would give squared distances that a long doesn't hold.
LIMIT = 1 << 27
#: Share of |x|^2 + |c|^2 by which the bounds may be off for rounding; 2**-53 for each of a few operations is far below.
SLACK = 1e-11
#: Rows for which bounds are made at once.
ROWS = 8192


def _matrix(column: pa.Array, d: int, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, d)


def segment_norms(v: np.ndarray) -> np.ndarray:
    """Squared norms of the segments of each row; the last segment may be shorter."""
    squares = v.astype(np.int64) ** 2
    return np.add.reduceat(squares, np.arange(0, v.shape[1], SEGMENT), axis=1)


def integer_vectors(df: DataFrame, d: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (integers) and norms of the vectors that have d components, none null or not finite; others are left out.

    A component becomes floor(scale * x). Raises an error where its magnitude reaches LIMIT.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), d), False))
            x = _matrix(batch.column("v"), d, np.float64)
            whole = np.isfinite(x).all(1)
            ids, v = batch.column("vec_id").filter(pa.array(whole)), np.floor(scale * x[whole])
            if len(v) and np.abs(v).max() >= LIMIT:
                raise ValueError(f"a component is {np.abs(v).max():.0f} after scaling; distances are exact below {LIMIT}")
            norms = segment_norms(v.astype(np.int64))
            ends = np.arange(len(v) + 1, dtype=np.int32)
            yield pa.record_batch(
                [ids, pa.ListArray.from_arrays(ends * d, v.astype(np.int32).ravel()), pa.ListArray.from_arrays(ends * norms.shape[1], norms.ravel())],
                ["vec_id", "v", "norms"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_arrow(rows, prepare, "vec_id long, v array<int>, norms array<long>")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in this order; equal ids by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("order"), "v").orderBy(F.col("order").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number), squared distance, and how many exact distances it took."""
    c_norms = segment_norms(centroids)
    total = norms.sum(1)[:, None].astype(float) + c_norms.sum(1)[None, :]
    low = total * (1 - SLACK) - 2 * (np.sqrt(norms) @ np.sqrt(c_norms).T)

    def exact(rows, j) -> np.ndarray:
        apart = v[rows].astype(np.int64) - centroids[j]
        return np.einsum("ij,ij->i", apart, apart)

    cluster = low.argmin(1)
    tried, first = np.ones(len(v), np.int64), cluster.copy()
    best = exact(slice(None), cluster)
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        if not len(rows):
            continue
        tried[rows] += 1
        distance = exact(rows, j)
        closer = (distance < best[rows]) | (distance == best[rows]) & (j < cluster[rows])
        best[rows[closer]], cluster[rows[closer]] = distance[closer], j
    return cluster, best, tried


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            segments = -(-d // SEGMENT)
            yield part.column("vec_id"), _matrix(part.column("v"), d, np.int32), _matrix(part.column("norms"), segments, np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid. A task gives a row for each centroid at most."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, v, norms in _parts(batches, d):
            cluster, _, _ = nearest(v, norms, centroids)
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                sums[j] += v[cluster == j].sum(0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = map_arrow(vectors, add, "cluster int, n long, s array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(d)]).alias("s")).collect()
    return {r.cluster: (r.n, [int(x) for x in r.s]) for r in rows}


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, d: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", keep: Callable | None = None) -> DataFrame:
    """Assign every whole vector to one of k centroids after so many rounds of assignment and update.

    Columns: vec_id, cluster int, distance long (squared, in scaled integers), cluster_inertia and inertia long,
    centroid_sha256 string, n_exact int (exact distances that the last assignment of the vector took). keep, where
    given, is called with the final centroids.

    Vectors that are null, of another length, or with a null or non-finite component give no row; repeated rows and ids
    are vectors of their own; null ids start a centroid only where fewer than k others are there; ties go to the smaller
    centroid; a centroid without vectors stays where it is; with fewer than k vectors there are so many centroids. An
    empty table gives no row. Other columns are not read. Only k rows of sums and of inertias reach the driver.
    """
    spark = df.sparkSession
    vectors = materialise(integer_vectors(df, d, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, seed).reshape(-1, d)
    for _ in range(rounds if len(centroids) else 0):
        for j, (n, sums) in _sums(vectors, centroids).items():
            centroids[j] = [s // n for s in sums]
    if keep:
        keep(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, norms in _parts(batches, d):
            found, distance, tried = nearest(v, norms, centroids)
            yield pa.record_batch([ids, pa.array(found, pa.int32()), pa.array(distance), pa.array(tried, pa.int32())], ["vec_id", "cluster", "distance", "n_exact"])

    assigned = materialise(map_arrow(vectors, assign, "vec_id long, cluster int, distance long, n_exact int"), "assigned")
    dropped(vectors)
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(j, s, sum(inertia.values()), sha(centroids[j])) for j, s in inertia.items()]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")


_ASSIGN = """
{name}_pairs AS (
    SELECT row_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
    FROM vectors, {centroids}),
{name} AS (
    SELECT row_id, v, j, distance FROM {name}_pairs
    QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, j) = 1)"""

_UPDATE = """
{name}_sums AS (
    SELECT j, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM {assigned}, range(1, 65) AS r(i) GROUP BY j, i),
{name} AS (
    SELECT {centroids}.j, coalesce(m.c, {centroids}.c) AS c
    FROM {centroids}
    LEFT JOIN (
        SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM {name}_sums GROUP BY j) m
    ON {centroids}.j = m.j)"""


def _sql(rounds: int = 3) -> str:
    steps = [
        """WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
vectors AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS row_id FROM whole),
c0 AS (
    SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS j, v AS c FROM vectors
    QUALIFY j < 16)"""
    ]
    for n in range(rounds):
        steps.append(_ASSIGN.format(name=f"a{n}", centroids=f"c{n}"))
        steps.append(_UPDATE.format(name=f"c{n + 1}", assigned=f"a{n}", centroids=f"c{n}"))
    steps.append(_ASSIGN.format(name="last", centroids=f"c{rounds}"))
    return (
        ",".join(steps)
        + f"""
SELECT vec_id, last.j AS cluster, distance,
    (sum(distance) OVER (PARTITION BY last.j))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM last JOIN vectors USING (row_id) JOIN c{rounds} ON c{rounds}.j = last.j"""
    )


OP11_SQL = _sql()
