"""Paths from parent-pointer records, by doubling: each round joins a path with the path of the ancestor it ends at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.scratch import materialise

MASK = 0x0000FFFFFFFFFFFF
#: Components after which a chain is cut off as a cycle would never end.
DEPTH = 512
#: A directory is wide from this share of all rows, so there are at most so many wide ones.
WIDE = 4096


def clean_records(records: DataFrame) -> DataFrame:
    """Records with names, references cut to 48 bits."""
    kept = records.filter(~F.col("name").isin("", ".", ".."))
    return kept.withColumns({c: F.col(c).bitwiseAND(F.lit(MASK)) for c in ("file_ref", "parent_ref")})


def last_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """Of records that repeat a file_ref the last by ``order``, whole."""
    names = [c for c in records.columns if c != "file_ref"]
    return records.groupBy("file_ref").agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("file_ref", "r.*").select(*records.columns)


def _above(rows: DataFrame, parents: DataFrame, total: int) -> DataFrame:
    """Left join of rows with parents (up, ...); wide directories, at most WIDE, are broadcast instead of shuffled."""
    wide = rows.groupBy("up").agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1000, total // WIDE)).select("up")
    wide = F.broadcast(wide)
    few = F.broadcast(parents.join(wide, "up", "left_semi"))
    return rows.join(wide, "up", "left_semi").join(few, "up", "left").unionByName(rows.join(wide, "up", "left_anti").join(parents, "up", "left"))


def resolve_paths(records: DataFrame, prefix: str, separator: str = "\\", order: str | None = "seq") -> DataFrame:
    """(file_ref, path, depth). A record that is its own parent is a root without a name of its own and gives no row;
    a record whose parent is missing begins a path; of records that repeat a file_ref the last by ``order`` counts, None
    where none repeats. Records in a cycle, or deeper than DEPTH, give no row.

    Only rows whose path isn't complete take part in a round.
    """
    rows = (last_records(records, order) if order else records).select("file_ref", "parent_ref", "name")
    rows = materialise(rows, "records")
    total = rows.count()
    roots = rows.filter("file_ref = parent_ref").select(F.col("file_ref").alias("up"))
    rows = rows.filter("file_ref <> parent_ref or parent_ref is null")
    named = rows.select(F.col("file_ref").alias("up")).join(roots, "up", "left_anti").withColumn("named", F.lit(True))
    state = _above(rows.select("file_ref", "name", F.col("parent_ref").alias("up")), named, total)
    state = materialise(state.select("file_ref", F.col("name").alias("path"), F.when(F.col("named"), F.col("up")).alias("up"), F.lit(1).alias("depth")), "paths")
    done, open_ = state.filter("up is null"), state.filter("up is not null")
    for _ in range(DEPTH.bit_length()):
        if open_.isEmpty():
            break
        above = done.unionByName(open_).select(F.col("file_ref").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"), F.col("depth").alias("more"))
        # a parent that is gone was too deep, and so is all below it
        step = _above(open_, above, total).filter("head is not null")
        step = step.select("file_ref", F.concat_ws(separator, "head", "path").alias("path"), F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        step = materialise(step.filter(f"depth <= {DEPTH + 1}"), "paths")
        done, open_ = done.unionByName(step.filter("up is null")), step.filter("up is not null")
    return done.select("file_ref", F.concat(F.lit(prefix), F.col("path")).alias("path"), "depth")
