"""The catalog's store: Parquet folders by buckets of paths, and a file that names those that count.

A save writes new folders and then swaps the file, so readers see one state or the other. Changes rewrite the buckets
of their paths alone. Folders may be in any store that Spark writes to.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.columns import derived
from trawl.model import CATALOG, IndexStorageError
from trawl.scratch import Files

VERSION = 4
#: Buckets of a new store, and rows that a bucket is meant to hold.
LEAST_BUCKETS, PER_BUCKET = 4, 1_000_000
COLUMNS = [c.split()[0] for c in CATALOG.split(", ")]


def _files() -> Files:
    return Files(SparkSession.active())


def exists(folder: str) -> bool:
    return _files().exists(f"{folder}/meta.json")


def meta(folder: str) -> dict:
    try:
        return json.loads(_files().read(f"{folder}/meta.json"))
    except Exception as e:
        raise IndexStorageError(f"{folder}: {e}") from e


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, folder: str, generation: int, buckets: int) -> tuple[dict[str, str], DataFrame]:
    """Folders by bucket of the rows written, and the rows."""
    segment = f"segment-{generation}-{uuid.uuid4().hex[:8]}"
    rows = derived(rows.select(*COLUMNS)).withColumn("_bucket", bucket_of(F.col("path"), buckets))
    # large buckets are split over tasks by a second hash
    rows.repartition("_bucket", F.pmod(F.xxhash64("path", F.lit(1)), F.lit(4))).write.partitionBy("_bucket").parquet(f"{folder}/{segment}")
    found = {n.split("=")[1]: f"{segment}/{n}" for n in _files().names(f"{folder}/{segment}") if n.startswith("_bucket=")}
    spark = rows.sparkSession
    paths = [f"{folder}/{p}" for p in found.values()]
    return found, spark.read.parquet(*paths) if paths else derived(spark.createDataFrame([], CATALOG))


def _swap(folder: str, before: dict, out: dict) -> dict:
    files = _files()
    files.write(f"{folder}/meta.json", json.dumps(out))
    gone = set(before.get("segments", {}).values()) - set(out["segments"].values())
    for old in gone:
        files.delete(f"{folder}/{old}")
    kept = {p.split("/")[0] for p in out["segments"].values()}
    for segment in {p.split("/")[0] for p in gone} - kept:
        files.delete(f"{folder}/{segment}")
    return out


def save(catalog: DataFrame, folder: str) -> dict:
    """Writes rows and search columns as a new generation; the one before goes once the file is swapped."""
    before = meta(folder) if exists(folder) else {"generation": 0}
    generation = before["generation"] + 1
    buckets = before.get("buckets") or max(LEAST_BUCKETS, -(-catalog.count() // PER_BUCKET))
    segments, stored = _write(catalog, folder, generation, buckets)
    counts = stored.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()
    out = {"version": VERSION, "generation": generation, "doc_count": counts["n"], "next_id": counts["last"] + 1, "created_at": int(time.time()), "buckets": buckets, "segments": segments}
    return _swap(folder, before, out)


def replace(folder: str, paths: DataFrame, change) -> dict:
    """The store after ``change(rows)``, which may change rows of ``paths`` (path) alone: only their buckets are read and
    written. change gets the rows of these buckets, and what it returns takes their place."""
    before = meta(folder)
    buckets, generation = before["buckets"], before["generation"] + 1
    touched = sorted(r[0] for r in paths.select(bucket_of(F.col("path"), buckets)).distinct().collect())
    if not touched:
        return before
    old = {str(b): before["segments"][str(b)] for b in touched if str(b) in before["segments"]}
    spark = paths.sparkSession
    rows = spark.read.parquet(*[f"{folder}/{p}" for p in old.values()]) if old else derived(spark.createDataFrame([], CATALOG))
    counted = rows.count()
    segments, stored = _write(change(rows.select(*COLUMNS)), folder, generation, buckets)
    counts = stored.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()
    others = {b: p for b, p in before["segments"].items() if b not in old}
    if set(others) & set(segments):
        raise IndexStorageError("a change made rows of other paths")
    out = before | {"generation": generation, "doc_count": before["doc_count"] - counted + counts["n"], "next_id": max(before["next_id"], counts["last"] + 1), "segments": others | segments}
    return _swap(folder, before, out)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All segments; one that is missing is left out, a damaged one is an error when it is read."""
    files = Files(spark)
    found = [p for p in (f"{folder}/{s}" for s in meta(folder)["segments"].values()) if files.exists(p)]
    if not found:
        return derived(spark.createDataFrame([], CATALOG))
    return spark.read.parquet(*found)


def load_legacy(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rows, as old stores have them."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def delete(folder: str) -> None:
    _files().delete(folder)


def size(folder: str) -> int:
    return _files().size(folder)
