"""Catalogs from a volume's parent-pointer records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.columns import extension, from_file_time
from trawl.operators.catalog_ops import union_roots
from trawl.operators.filters import excluded
from trawl.operators.hierarchy import clean_records, last_records, resolve_paths


def scan_volume(records: DataFrame, letter: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Catalog rows of one volume; sizes aren't in the records and are 0. Ids are the records' references; of records
    that repeat one the last by seq counts, for the name as for the path."""
    rows = last_records(clean_records(records))
    paths = resolve_paths(rows, f"{letter}:\\", order=None).select("file_ref", "path")
    out = rows.join(paths, "file_ref").filter(~excluded(F.col("path"), exclude, "\\"))
    return out.select(F.col("file_ref").alias("id"), "name", "path", extension(F.col("name")).alias("extension"), F.lit(0).cast("long").alias("size"), from_file_time(F.col("file_time")).alias("modified"), "is_dir", F.lit(None).cast("string").alias("content_hash"))


def scan_volumes(volumes: dict[str, DataFrame], exclude: Iterable[str] = ()) -> DataFrame:
    """All volumes; a failure of one fails all."""
    return union_roots([scan_volume(r, letter, exclude) for letter, r in sorted(volumes.items())])
