"""Exact order statistics of each key without sorting a key's rows in one task.

Values are counted in bins of each key's range, with map-side sums, so that a key of any size moves a row a bin and
task. The bin that holds a wanted place is told from the running sums of a key's bins, and only the values of that bin
are counted again, in finer bins, and at last one by one with their multiplicities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import valid

#: Bins of each pass: what a window over one key's bins holds at most.
BINS = 1 << 12


def _finer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, _q: which place is asked, _k: place within these rows, _v) that lie in the bin of the place."""
    ends = rows.groupBy(*keys, "_q").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    bin_ = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    dealt = rows.join(ends, [*keys, "_q"]).withColumn("_bin", bin_)
    counts = dealt.groupBy(*keys, "_q", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k"))
    before = F.sum("_c").over(W.partitionBy(*keys, "_q").orderBy("_bin")) - F.col("_c")
    here = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_c")))
    return dealt.drop("_k", "_a", "_b").join(here.select(*keys, "_q", "_bin", (F.col("_k") - F.col("_before")).alias("_k")), [*keys, "_q", "_bin"]).drop("_bin")


def order_statistics(a: DataFrame, keys: list[str], column: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and a column for each place: the value that stands there (from 0) when a key's values are sorted.

    A place is a function of the number of values; one beyond the last gives null. NaN and null don't count.
    """
    rows = a.where(valid(column)).select(*keys, F.col(column).alias("_v"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    asked = n.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("q"), f(F.col("_n")).cast("long").alias("k")) for q, f in places.items()])).alias("_p"))
    start = rows.join(asked.select(*keys, F.col("_p.q").alias("_q"), F.col("_p.k").alias("_k")), keys)
    near = _finer(_finer(start, keys), keys)
    counts = near.groupBy(*keys, "_q", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k"))
    upto = F.sum("_c").over(W.partitionBy(*keys, "_q").orderBy("_v"))
    found = counts.withColumn("_upto", upto).where((F.col("_upto") - F.col("_c") <= F.col("_k")) & (F.col("_k") < F.col("_upto")))
    return n.select(*keys).join(found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == q, F.col("_v"))).alias(q) for q in places]), keys, "left")


def ranks(a: DataFrame, keys: list[str], column: str, ties: list) -> DataFrame:
    """a with _rank (from 1 for the least value, equal ones in the order of `ties`) and _n, the values of the key.

    Rows are numbered within bins of their key's range, and the rows of the bins before are added. Rows whose value is NaN
    or null are left out.
    """
    rows = a.where(valid(column))
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_a"), F.max(column).alias("_b"), F.count(F.lit(1)).alias("_n"))
    share = (F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    dealt = rows.join(ends, keys).withColumn("_bin", F.when(F.col("_b") > F.col("_a"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)))
    counts = dealt.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*keys, "_bin", (F.sum("_c").over(W.partitionBy(*keys).orderBy("_bin")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(W.partitionBy(*keys, "_bin").orderBy(column, *ties))
    return dealt.join(before, [*keys, "_bin"]).withColumn("_rank", F.col("_before") + place).drop("_a", "_b", "_bin", "_before")
