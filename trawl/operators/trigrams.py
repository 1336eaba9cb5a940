"""Trigram candidates: a predicate on each row, and the inverted table with relational division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.columns import name_key


def codes_of(text: str) -> list[str]:
    """Distinct trigrams of a lower-cased text; one or two characters are filled with spaces."""
    low = text.lower()
    if not low:
        return []
    low = low.ljust(3) if len(low) < 3 else low
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def codes(name: Column) -> Column:
    key = name_key(name)
    windows = F.transform(F.sequence(F.lit(1), F.length(key) - 2), lambda i: F.substring(key, i, F.lit(3)))
    return F.when(F.length(key) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def contains_all(keyword: str) -> Column:
    """A row is a candidate if its name has every trigram of the keyword; needs the column name_key."""
    found = [F.col("name_key").contains(c) for c in codes_of(keyword)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def postings(catalog: DataFrame) -> DataFrame:
    """(trigram, id), a row for each trigram of each name."""
    return catalog.select(F.explode(codes(F.col("name"))).alias("trigram"), "id")


def add(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The postings with those of new catalog rows."""
    return table.unionByName(postings(rows))


def remove(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings without those of ids (id); a trigram without ids is gone with its last row."""
    return table.join(ids.select("id"), "id", "left_anti").select("trigram", "id")


def legacy(text: Column) -> Column:
    """All windows of three characters in their order, repeats kept; a shorter text is its own one, an empty one has none."""
    low = F.lower(text)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) == 0, F.array().cast("array<string>")).otherwise(windows)


def legacy_hash(trigram: Column) -> Column:
    return F.crc32(trigram)


def candidates(table: DataFrame, keyword: str) -> DataFrame:
    """Ids that have every trigram of the keyword."""
    wanted = codes_of(keyword)
    return table.filter(F.col("trigram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count_distinct("trigram").alias("trigram_count"), F.count("*").alias("posting_count"))
