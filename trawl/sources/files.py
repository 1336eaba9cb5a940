"""Sources of the local file system: directory walks, volumes and contents."""

from __future__ import annotations

import datetime
import os
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trawl.config import CONTENT_EXTENSIONS, CONTENT_MAX_SIZE
from trawl.functions.columns import extension, file_name
from trawl.model import CATALOG, PlatformError, ScanError
from trawl.operators.catalog_ops import status_counts
from trawl.scratch import materialise

WALK = "path string, size long, modified timestamp_ntz, is_dir boolean, status string"
# File system types that hold no files of users.
VIRTUAL = ("proc", "sysfs", "tmpfs", "devpts", "cgroup", "cgroup2", "securityfs", "pstore", "debugfs", "fusectl", "configfs", "hugetlbfs", "mqueue", "binfmt_misc", "tracefs")


#: Parts that a walk is split into at least, where there are as many folders.
PARTS = 256


class _Part(InputPartition):
    """A folder with its own row or without, and with all below or only its entries."""

    def __init__(self, folder: str, own: bool, deep: bool):
        self.folder, self.own, self.deep = folder, own, deep


def split(roots: Iterable[str], parts: int = PARTS) -> list[_Part]:
    """Parts of the walks of all roots: folders are opened, the uppermost first, until there are enough."""
    flat, deep = [], deque(_Part(r, True, True) for r in roots)
    while deep and len(flat) + len(deep) < parts:
        part = deep.popleft()
        try:
            with os.scandir(part.folder) as entries:
                below = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        except OSError:
            below = []
        flat.append(_Part(part.folder, part.own, False))
        deep.extend(_Part(b, False, True) for b in sorted(below))
    return [*flat, *deep]


def _is_excluded(path: str, patterns: set[str]) -> bool:
    return any(part.lower() in patterns for part in path.split(os.sep))


def walk(root: str, patterns: Iterable[str] = (), own: bool = True, deep: bool = True) -> Iterator[tuple]:
    """(path, size, modified, is_dir, status) of the root and all below; links to directories are rows but aren't followed.

    Without ``own`` the root is left out, without ``deep`` all but its entries.
    """
    patterns = {p.lower() for p in patterns}
    failed: list[OSError] = []

    def row(path: str) -> tuple:
        if _is_excluded(path, patterns):
            return path, None, None, None, "skipped"
        try:
            info = os.stat(path)
        except OSError:
            return path, None, None, None, "error"
        is_dir = os.path.isdir(path)
        at = datetime.datetime.fromtimestamp(max(info.st_mtime, 0), datetime.UTC).replace(tzinfo=None)
        return path, 0 if is_dir else info.st_size, at, is_dir, "indexed"

    if own:
        yield row(root)
    for folder, folders, files in os.walk(root, onerror=failed.append):
        for name in [*folders, *files]:
            yield row(os.path.join(folder, name))
        if not deep:
            break
    for e in failed:
        yield e.filename, None, None, None, "error"


class _WalkReader(DataSourceReader):
    def __init__(self, options):
        self.roots = options.get("roots", options.get("path", "")).split("\n")
        self.patterns = [p for p in options.get("exclude", "").split("\n") if p]

    def partitions(self):
        return split(self.roots)

    def read(self, partition):
        yield from walk(partition.folder, self.patterns, partition.own, partition.deep)


class WalkSource(DataSource):
    """Format "trawl-walk": options roots (one a line) and exclude (one a line); split by folders."""

    @classmethod
    def name(cls):
        return "trawl-walk"

    def schema(self):
        return WALK

    def reader(self, schema):
        return _WalkReader(self.options)


def with_ids(rows: DataFrame, first: int = 1) -> DataFrame:
    """Ids from ``first`` in the order of paths, without a window over all rows: places within ranges, offset by the ranges' sizes."""
    from pyspark.sql import Window

    ranged = materialise(rows.repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "walked")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("path"))
    return ranged.withColumn("_place", place).join(F.broadcast(sizes), "_part").withColumn("id", F.col("_place") + F.col("_before") + F.lit(first - 1)).drop("_part", "_place", "_before")


def build_rows(walked: DataFrame, first: int = 1) -> DataFrame:
    """Catalog rows of the entries that could be read."""
    path = F.col("path")
    rows = with_ids(walked.filter("status = 'indexed'"), first)
    return rows.select("id", file_name(path).alias("name"), "path", extension(file_name(path)).alias("extension"), "size", "modified", "is_dir", F.lit(None).cast("string").alias("content_hash"))


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = (), first: int = 1, counters: Observation | None = None) -> DataFrame:
    """The catalog of one root, which must be a directory."""
    if not os.path.isdir(root):
        raise ScanError(f"{root} is no directory")
    return scan_roots(spark, [root], exclude, first, counters)


def scan_roots(spark: SparkSession, roots: list[str], exclude: Iterable[str] = (), first: int = 1, counters: Observation | None = None) -> DataFrame:
    """The catalog of several roots; those that are no directories are left out, and what overlaps stays twice.

    The walk runs at once; counters, if given, then has the numbers of entries indexed, skipped and in error.
    """
    good = [r for r in roots if os.path.isdir(r)]
    if not good:
        return spark.createDataFrame([], CATALOG)
    spark.dataSource.register(WalkSource)
    walked = spark.read.format("trawl-walk").option("roots", "\n".join(good)).option("exclude", "\n".join(exclude)).load()
    if counters is not None:
        walked = walked.observe(counters, *status_counts())
    # written, as a walk isn't the same twice
    return build_rows(materialise(walked, "walk"), first)


def volumes(spark: SparkSession, mounts: str = "file:///proc/mounts") -> DataFrame:
    """(mount_point, fs_type) of a mounts table without virtual file systems; / where there is none."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(mounts).select(parts.alias("p")).filter(F.size("p") >= 3)
    rows = rows.select(F.col("p")[1].alias("mount_point"), F.col("p")[2].alias("fs_type")).filter(~F.col("fs_type").isin(*VIRTUAL) & F.col("mount_point").startswith("/"))
    if rows.isEmpty():
        return spark.createDataFrame([("/", None)], "mount_point string, fs_type string")
    return rows


def scan_volumes(spark: SparkSession, exclude: Iterable[str] = ()) -> DataFrame:
    return scan_roots(spark, [r["mount_point"] for r in volumes(spark).collect()], exclude)


def native_scan(*_args) -> DataFrame:
    """Volume scans through an operating system's own interfaces can't run in Spark."""
    raise PlatformError("native volume scans need the platform's own interface")


def allowed(ext: Column, extensions: Iterable[str] = CONTENT_EXTENSIONS) -> Column:
    return (ext != "") & F.lower(ext).isin(list(extensions))


def contents(catalog: DataFrame, extensions: Iterable[str] = CONTENT_EXTENSIONS, max_size: int = CONTENT_MAX_SIZE) -> DataFrame:
    """(id, content) of files with an allowed extension, at most max_size bytes and valid UTF-8."""
    most = min(max_size, CONTENT_MAX_SIZE)
    rows = catalog.filter(~F.col("is_dir") & allowed(F.col("extension"), extensions) & (F.col("size") <= most)).select("id", "path")
    schema = pa.schema([("id", pa.int64()), ("content", pa.string())])

    def read(batches):
        for batch in batches:
            for i, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        raw = f.read(most + 1)
                    # a file that has grown past the limit since the scan is left out
                    if len(raw) > most:
                        continue
                    text = raw.decode()
                except (OSError, UnicodeDecodeError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text])], schema=schema)

    return rows.mapInArrow(read, "id long, content string")
