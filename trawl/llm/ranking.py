"""Gapless positions without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window is meant to sort.
PER_BUCKET = 20_000


def gapless(rows: DataFrame, groups: list[str], spread: Column, order: list[Column], total: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each group, in the order of hashed buckets and of ``order`` within a bucket.

    Rows are numbered within (group, bucket), and buckets are offset by the sizes of those before. The number of
    buckets follows ``total``, so no window holds a whole group; the sizes are one row for each group and bucket.
    """
    buckets = max(1, -(-total // PER_BUCKET)) * 4
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(spread, F.lit(77)), F.lit(buckets)))
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(sizes, [*groups, "_bucket"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket")
