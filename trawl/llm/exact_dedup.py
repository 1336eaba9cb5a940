"""Exact deduplication through a log-structured merge index of digests, in DataFrame operations only.

Memtables, slices of the table's digests, are flushed as sorted runs, each with a filter of its digests. A level that
is full is compacted into one run of the next level, which keeps one identifier and a count for each digest. Rows whose
digest the filter of repeated ones doesn't hold are alone and take no further part. Texts under a digest that holds
several rows are verified byte by byte: the smallest and the largest text of the digest must be the same. Where they
differ, the texts themselves are the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import bitmaps
from trawl.llm.skew import join_by_size
from trawl.llm.store import materialise, written
from trawl.scratch import new_path

ENTRY = "digest binary, keep_id long, n long"
#: Rows that a memtable is meant to hold, memtables of a table at most, and runs that fill a level.
MEMTABLE_ROWS, MOST_MEMTABLES, FANOUT = 1_000_000, 16, 4


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased. All-ASCII texts take Spark's fast path, which does the same to them."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Run:
    """A folder of sorted entries and the filter of their digests, by pages of bits."""

    path: str
    rows: DataFrame
    pages: DataFrame
    bits: int


class DigestIndex:
    """Runs of (digest, keep_id, n) in the shared folder, by levels."""

    def __init__(self, spark: SparkSession, keep: str = "min", folder: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep = spark, keep
        self.folder = folder or written(new_path(spark, "digests"))
        self.levels: list[list[Run]] = [[]]

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _write(self, entries: DataFrame, level: int) -> Run:
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        sorted_ = entries.select("digest", "keep_id", "n").sortWithinPartitions("digest")
        sorted_.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        rows = self.spark.read.schema(ENTRY).parquet(path)
        bits = bitmaps.bits_for(rows.count())
        return Run(path, rows, materialise(bitmaps.build(rows, F.xxhash64("digest"), bits), "filter"), bits)

    def _merge(self, runs: list[Run], level: int) -> Run:
        """One run of one row a digest. Map-side sums keep a digest with many copies from meeting in one task."""
        best = F.min("keep_id") if self.keep == "min" else F.max("keep_id")
        rows = self.spark.read.schema(ENTRY).parquet(*[r.path for r in runs])
        return self._write(rows.groupBy("digest").agg(best.alias("keep_id"), F.sum("n").alias("n")), level)

    def flush(self, entries: DataFrame) -> DataFrame:
        """Writes a memtable (digest, keep_id) as a run of level 0, compacts levels that are full, and returns the run's rows."""
        run = self._write(entries.select("digest", "keep_id", F.lit(1).cast("long").alias("n")), 0)
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(self.levels[level], level + 1))
            self.levels[level] = []
            level += 1
        return run.rows

    def compact(self) -> DataFrame:
        """Merges all runs into one of the last level, one row a digest, and returns its rows."""
        level = max(len(self.levels) - 1, 1)
        if len(self.runs) > 1 or self.levels[0]:
            self.levels = [*([] for _ in range(level)), [self._merge(self.runs, level)]]
        return self.runs[0].rows

    def maybe(self, rows: DataFrame, digest: str = "digest") -> DataFrame:
        """rows with the boolean _maybe: false only if no run has the digest, by the runs' filters."""
        out = rows.withColumn("_any", F.lit(False))
        for run in self.runs:
            out = bitmaps.probe(out, F.xxhash64(digest), run.pages, run.bits).withColumn("_any", F.col("_any") | F.col("_maybe")).drop("_maybe")
        return out.withColumnRenamed("_any", "_maybe")

    def known(self, rows: DataFrame) -> DataFrame:
        """The rows (digest, ...) whose digest some run has: filters first, a join for what they leave."""
        some = self.maybe(rows).filter("_maybe").drop("_maybe")
        return some.join(self.spark.read.schema(ENTRY).parquet(*[r.path for r in self.runs]).select("digest"), "digest", "left_semi") if self.runs else some

    def find(self, digest: bytes) -> DataFrame:
        """Entries of one digest; files whose filter lacks it are skipped."""
        return self.spark.read.schema(ENTRY).parquet(*[r.path for r in self.runs]).filter(F.col("digest") == F.lit(digest))


def _indexed(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column]):
    """Rows with digest and text, their entries, the compacted index, the filter of its digests of several rows, and of
    those the digests whose texts differ."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(docs.sparkSession, keep)
    entries = rows.select("digest", F.col("doc_id").alias("keep_id"))
    tables = min(MOST_MEMTABLES, -(-docs.count() // MEMTABLE_ROWS))
    if tables <= 1:
        entries = index.flush(entries).select("digest", "keep_id")
    else:
        # texts are hashed once; memtables are read from what is written here
        path = written(new_path(docs.sparkSession, "entries"))
        entries.withColumn("memtable", F.spark_partition_id() % tables).write.partitionBy("memtable").parquet(path)
        entries = docs.sparkSession.read.schema("digest binary, keep_id long, memtable int").parquet(path)
        for number in range(tables):
            index.flush(entries.filter(F.col("memtable") == number))
        entries = entries.select("digest", "keep_id")
    merged = index.compact()
    hits = merged.filter("n > 1")
    bits = bitmaps.bits_for(hits.count())
    pages = materialise(bitmaps.build(hits, F.xxhash64("digest"), bits), "filter")
    suspects = bitmaps.probe(rows, F.xxhash64("digest"), pages, bits).filter("_maybe").drop("_maybe")
    differ = suspects.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")
    return rows, entries, merged, (pages, bits), suspects, materialise(differ, "collisions")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The smallest id of equal
    texts stays (keep="max": the largest). A row without id never stays beside one with an id; where no row of the
    group has one, keep_id is null and all stay. Rows that repeat an id are the same document: they share the
    decision and count in group_size. An empty table gives no rows. Other columns of docs don't matter.
    """
    rows, entries, merged, (pages, bits), suspects, differ = _indexed(docs, id_col, text_col, keep, digest)
    total = entries.count()
    marked = bitmaps.probe(entries.select("digest", F.col("keep_id").alias("doc_id")), F.xxhash64("digest"), pages, bits)
    alone = marked.filter(~F.col("_maybe")).select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    entries = marked.filter("_maybe").drop("_maybe")
    merged = bitmaps.probe(merged, F.xxhash64("digest"), pages, bits).filter("_maybe").drop("_maybe").withColumnRenamed("n", "group_size")
    if differ.isEmpty():
        out = join_by_size(entries, merged, ["digest"], "group_size", total)
    else:
        best = F.min("doc_id") if keep == "min" else F.max("doc_id")
        odd = suspects.join(differ, "digest")
        exact = odd.groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        out = join_by_size(entries.join(differ, "digest", "left_anti"), merged.join(differ, "digest", "left_anti"), ["digest"], "group_size", total)
        out = out.unionByName(join_by_size(odd, exact, ["digest", "text"], "group_size", total).drop("text"))
    out = out.unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs, all columns, without exact duplicates; of equal texts one row stays.

    Rows whose digest the filter doesn't hold pass without a shuffle; only rows of repeated texts move.
    Rows that repeat id and text count once.
    """
    _, _, merged, (pages, bits), _, differ = _indexed(docs, id_col, text_col, keep, digest)
    names = docs.columns
    keyed = docs.withColumn("_text", normalised(F.col(text_col))).withColumn("_digest", digest(F.col("_text")))
    keyed = bitmaps.probe(keyed, F.xxhash64("_digest"), pages, bits)
    alone = keyed.filter(~F.col("_maybe")).select(*names)
    maybe = keyed.filter("_maybe").withColumn("_id", F.col(id_col).cast("long"))
    if differ.isEmpty():
        best = merged.select(F.col("digest").alias("_digest"), "keep_id")
        keys = ["_digest"]
    else:
        pick = F.min("_id") if keep == "min" else F.max("_id")
        best = maybe.groupBy("_digest", "_text").agg(pick.alias("keep_id"))
        keys = ["_digest", "_text"]
    stay = maybe.join(best.withColumnRenamed("keep_id", "_id"), [*keys, "_id"], "left_semi")
    unnamed = maybe.filter("_id is null").join(best.filter("keep_id is null").drop("keep_id"), keys, "left_semi")
    return alone.unionByName(stay.unionByName(unnamed).dropDuplicates([*keys, "_id"]).select(*names))
