"""Lookups, changes and statistics of a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.columns import format_size
from trawl.operators import trigrams


def by_ids(catalog: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the ids in their order, repeats kept, unknown ids left out; ``at`` is the place in the list."""
    wanted = catalog.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids]) if ids else F.array().cast("array<bigint>")).alias("at", "id"))
    return catalog.join(F.broadcast(wanted), "id")


def contains(catalog: DataFrame, path: str) -> bool:
    return not catalog.filter(F.col("path") == path).isEmpty()


def union_roots(parts: list[DataFrame]) -> DataFrame:
    """All rows of all roots; what overlapping roots share stays twice."""
    return reduce(DataFrame.unionByName, parts)


def latest(rows: DataFrame, order: str = "id") -> DataFrame:
    """One row a path, the last by ``order``."""
    names = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*names), F.col(order)).alias("row")).select("path", "row.*").select(*rows.columns)


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog with rows put in by path; rows of the catalog that aren't among them stay."""
    new = latest(rows)
    return catalog.join(new.select("path"), "path", "left_anti").select(*catalog.columns).unionByName(new)


def remove(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("path"), "path", "left_anti").select(*catalog.columns)


def fold_changes(changes: DataFrame) -> DataFrame:
    """(path, event, at, seq): the last event of each path; a rename removes its origin and adds its path."""
    events = changes.select("path", F.when(F.col("event") == "Renamed", "Added").otherwise(F.col("event")).alias("event"), "at", "seq")
    gone = changes.filter("event = 'Renamed' and origin is not null").select(F.col("origin").alias("path"), F.lit("Removed").alias("event"), "at", "seq")
    # of two events at the same time and place in the log, the adding one counts
    order = F.struct("at", "seq", F.col("event") != "Removed")
    return events.unionByName(gone).groupBy("path").agg(F.max_by(F.struct("event", "at", "seq"), order).alias("last")).select("path", "last.*")


def apply_changes(catalog: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog after the changes; rows holds what added and modified paths have now."""
    last = fold_changes(changes)
    alive = latest(rows).join(last.filter("event <> 'Removed'").select("path"), "path", "left_semi").select(*catalog.columns)
    return remove(catalog, last).unionByName(alive)


def index_stats(catalog: DataFrame) -> DataFrame:
    """One row of counts."""
    own = catalog.agg(
        F.count("*").alias("total_documents"),
        F.count_if(~F.col("is_dir")).alias("total_files"),
        F.count_if(F.col("is_dir")).alias("total_directories"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_distinct(F.when(F.col("extension") != "", F.col("extension"))).alias("extension_count"),
    )
    return own.crossJoin(F.broadcast(trigrams.stats(trigrams.postings(catalog)))).withColumn("segment_count", F.lit(1).cast("long"))


def extension_groups(catalog: DataFrame) -> DataFrame:
    """(extension, n, first_id, last_id, total_size); sums on each side of the shuffle, ids aren't gathered."""
    return catalog.filter("extension <> ''").groupBy("extension").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("size").alias("total_size"))


def by_extension(catalog: DataFrame, extension: str) -> DataFrame:
    return catalog.filter((F.col("extension") == extension.lower()) & (F.col("extension") != ""))


def files(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("is_dir"))


def directories(catalog: DataFrame) -> DataFrame:
    return catalog.filter("is_dir")


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "error")]


def scan_counters(rows: DataFrame) -> DataFrame:
    """Counts by status of scanned entries: indexed, skipped, error."""
    return rows.agg(*status_counts())


def id_sets(catalog: DataFrame) -> DataFrame:
    """(kind, value, page, ids): the ids of each extension and of files and directories, as bitmaps of 32,768 ids.

    A page has 4 KB whatever the number of its ids, and ids are set on both sides of the shuffle, so no set of ids is
    gathered in one row.
    """
    kinds = F.array(F.struct(F.lit("extension").alias("kind"), F.col("extension").alias("value")), F.struct(F.lit("type").alias("kind"), F.when(F.col("is_dir"), "directory").otherwise("file").alias("value")))
    rows = catalog.select("id", F.explode(kinds).alias("k")).select("id", "k.kind", "k.value").filter("value <> ''")
    rows = rows.select("kind", "value", F.bitmap_bucket_number(F.col("id") + 1).alias("page"), F.bitmap_bit_position(F.col("id") + 1).alias("bit"))
    return rows.groupBy("kind", "value", "page").agg(F.bitmap_construct_agg("bit").alias("ids"))


def ids_of(sets: DataFrame, kind: str, value: str) -> DataFrame:
    """The ids of one set."""
    pages = sets.filter((F.col("kind") == kind) & (F.col("value") == value))
    byte = pages.select("page", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("ids")), lambda i: F.conv(F.hex(F.substring("ids", i, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte")).filter("byte <> 0")
    bits = byte.select("page", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(F.col("byte"), b) == 1)).alias("bit"))
    return bits.select(((F.col("page") - 1) * 32_768 + F.col("at") * 8 + F.col("bit")).alias("id"))


def text_line() -> Column:
    """A result as one line: sign, path, size, - for directories, and time to the minute."""
    return F.concat_ws("  ", F.when(F.col("is_dir"), "[D]").otherwise("[F]"), "path", F.when(F.col("is_dir"), "-").otherwise(format_size(F.col("size"))), F.date_format("modified", "yyyy-MM-dd HH:mm"))


def json_line() -> Column:
    return F.to_json(F.struct("*"))
