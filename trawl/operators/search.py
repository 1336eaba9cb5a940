"""Search: prune, filter, score, rank, limit, then snippets of the few rows that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.columns import derived, snippet
from trawl.model import RESULT_LIMIT, Query, SortField, SortOrder
from trawl.operators import trigrams
from trawl.operators.filters import moment, predicate

DERIVED = {"name_lower", "path_lower", "name_key", "stem"}


def tier(keyword: str) -> Column:
    """Name equal 100, stem equal 90, name begins 75, name contains 50, path contains 25, else 0."""
    name = F.col("name_lower")
    score = F.when(name == keyword, 100.0).when(F.col("stem") == keyword, 90.0).when(name.startswith(keyword), 75.0)
    return score.when(name.contains(keyword), 50.0).when(F.col("path_lower").contains(keyword), 25.0).otherwise(0.0)


def match_score(keywords: tuple[str, ...]) -> Column:
    """The mean of the keywords' tiers, 0 if one of them is 0, and 1 without keywords."""
    if not keywords:
        return F.lit(1.0)
    tiers = [tier(k) for k in keywords]
    mean = reduce(lambda a, b: a + b, tiers) / F.lit(float(len(tiers)))
    return F.when(F.least(*tiers) > 0, mean).otherwise(0.0) if len(tiers) > 1 else tiers[0]


def recency(as_of) -> Column:
    """1.10 up to seven whole days of age, 1.05 up to thirty, else 1; times to come count as new."""
    age = F.timestamp_diff("DAY", F.col("modified").cast("timestamp"), moment(as_of).cast("timestamp"))
    return F.when(age <= 7, 1.10).when(age <= 30, 1.05).otherwise(1.0)


def matches(catalog: DataFrame, query: Query) -> DataFrame:
    """Rows that pass the filters and match every keyword, with their score before ranking."""
    rows = catalog if set(catalog.columns) >= DERIVED else derived(catalog)
    rows = rows.filter(predicate(query.filters))
    for keyword in query.keywords:
        rows = rows.filter(trigrams.contains_all(keyword))
    return rows.withColumn("score", match_score(query.keywords)).filter("score > 0")


def order_of(query: Query) -> list[Column]:
    """The order of results; the id breaks ties, in the direction of the sort."""
    keys = {SortField.NAME: F.lower("name"), SortField.PATH: F.col("path"), SortField.SIZE: F.col("size"), SortField.MODIFIED: F.col("modified")}
    if query.sort_by is SortField.RELEVANCE:
        return [F.desc("score"), F.asc("id")]
    if query.sort_order is SortOrder.ASCENDING:
        return [keys[query.sort_by].asc(), F.asc("id")]
    return [keys[query.sort_by].desc(), F.desc("id")]


def ranked(rows: DataFrame, query: Query, as_of) -> DataFrame:
    """At most ``limit`` rows in order."""
    if query.sort_by is SortField.RELEVANCE:
        rows = rows.withColumn("score", F.col("score") * recency(as_of))
    return rows.orderBy(*order_of(query)).limit(RESULT_LIMIT if query.limit is None else query.limit)


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """What a front end shows of a result: its own limit, which can't exceed a result's."""
    return rows.limit(min(limit, RESULT_LIMIT))


def with_snippets(rows: DataFrame, contents: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """rows, at most a result's limit, with the snippet of the first keyword found in contents (id, content)."""
    if not keywords:
        return rows.withColumn("snippet", F.lit(None).cast("string"))
    # the rows are a limited result, so they are the side that is broadcast
    ids = rows.select("id")
    found = contents.join(F.broadcast(ids), "id").select("id", F.coalesce(*[snippet(F.col("content"), k) for k in keywords]).alias("snippet"))
    return rows.join(F.broadcast(found), "id", "left")


def search(catalog: DataFrame, query: Query, as_of, contents: DataFrame | None = None) -> DataFrame:
    out = ranked(matches(catalog, query), query, as_of)
    if query.search_content and contents is not None:
        return with_snippets(out, contents, query.keywords)
    return out.withColumn("snippet", F.lit(None).cast("string"))
