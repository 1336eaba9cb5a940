"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import bitmaps
from trawl.llm.store import materialise

#: A key is hot from this share of all rows; so there are at most so many hot keys, whatever the size of the data.
HOT_KEYS = 4096
#: Below this number of rows a key never counts as hot.
HOT_ROWS = 64


def join_by_size(big: DataFrame, small: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of big with small, which has one row a key and in ``size`` the rows that big has of it.

    The sizes add up to ``total`` at most, so at most HOT_KEYS keys can have total / HOT_KEYS rows each: those rows of
    small are broadcast, a bound that doesn't grow with the data. All other keys are joined by a shuffle in which no
    key is large.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = small.filter(F.col(size) > least), small.filter(F.col(size) <= least)
    columns = [*big.columns, *[c for c in small.columns if c not in keys]]
    others = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return big.join(F.broadcast(hot), keys).select(*columns).unionByName(others.select(*columns))


def beside(pairs: DataFrame, one: DataFrame, key: str, value: str, chunk: int = 256) -> DataFrame:
    """(a, b, x, y) for pairs (a, b), a written table, with the values of both; one has one row a key, of any width.

    No task gets over about ``chunk`` rows of an id: an id with n pairs is split into n / chunk parts while pairs are
    narrow, and its row in one is repeated as often, |one| + |pairs| / chunk rows in all.
    """
    total, left = pairs.count(), pairs.select("a", "b")
    one = one.select(F.col(key).alias("_id"), F.col(value).alias("_value"), F.lit(0).cast("long").alias("_part"))
    sides = {}
    for end in ("a", "b"):
        sizes = left.groupBy(end).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk)
        sizes = materialise(sizes.withColumn("_parts", F.ceil(F.col("_n") / F.lit(chunk))), "parts")
        side, part = one, F.lit(0).cast("long")
        if not sizes.isEmpty():
            left = join_by_size(left, sizes, [end], "_n", total, "left")
            part = F.coalesce(F.pmod(F.xxhash64("b" if end == "a" else "a"), F.col("_parts")), part)
            bits = bitmaps.bits_for(sizes.count())
            some = bitmaps.probe(one, F.xxhash64("_id"), materialise(bitmaps.build(sizes, F.xxhash64(end), bits), "filter"), bits).filter("_maybe")
            some = some.join(sizes.select(F.col(end).alias("_id"), "_parts"), "_id")
            side = side.unionByName(some.select("_id", "_value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts") - 1)).alias("_part")))
        left = left.withColumn(f"_{end}", part).drop("_n", "_parts")
        sides[end] = side.select(F.col("_id").alias(end), F.col("_part").alias(f"_{end}"), F.col("_value").alias("x" if end == "a" else "y"))
    left = materialise(left, "salted")
    return left.join(sides["a"], ["a", "_a"]).join(sides["b"], ["b", "_b"]).select("a", "b", "x", "y")
