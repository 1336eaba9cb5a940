"""The change log: JSON lines, read in batch or as a stream that keeps a stored catalog current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.catalog_ops import apply_changes, fold_changes
from trawl.scratch import Files, materialise
from trawl.sources import storage

KINDS = ("Added", "Modified", "Removed", "Renamed")
_LINE = "event_type string, path string, timestamp string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(event, path, origin, at, seq) of the column value; blank and corrupt lines are left out.

    event_type is a name, or an object {"Renamed": {"from": path}}. seq follows the order of lines in a partition.
    """
    row = F.from_json("value", _LINE)
    origin = F.get_json_object("value", "$.event_type.Renamed.from")
    out = lines.select(row.alias("r"), origin.alias("origin"), F.monotonically_increasing_id().alias("seq") if not lines.isStreaming else F.lit(0).cast("long").alias("seq"))
    event = F.when(F.col("origin").isNotNull(), "Renamed").otherwise(F.col("r.event_type"))
    at = F.try_to_timestamp(F.col("r.timestamp")).cast("timestamp_ntz")
    out = out.select(event.alias("event"), F.col("r.path").alias("path"), "origin", at.alias("at"), "seq")
    return out.filter(F.col("event").isin(*KINDS) & F.col("path").isNotNull())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def append_log(changes: DataFrame, path: str) -> None:
    """Writes changes (event, path, origin, at) as lines."""
    kind = F.when(F.col("event") == "Renamed", F.to_json(F.struct(F.struct(F.col("origin").alias("from")).alias("Renamed")))).otherwise(F.concat(F.lit('"'), F.col("event"), F.lit('"')))
    rest = F.substring(F.to_json(F.struct("path", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))), F.lit(2), F.lit(1 << 30))
    changes.select(F.concat(F.lit('{"event_type":'), kind, F.lit(","), rest).alias("value")).write.mode("append").text(path)


def clear_log(spark: SparkSession, path: str) -> None:
    """Deletes the lines, a file or a folder of files; none is no error."""
    Files(spark).delete(path)


def from_watch(events: DataFrame) -> DataFrame:
    """(event, path, origin, at, seq) of watch events (kind, paths, at, seq): one row a path; other kinds are dropped."""
    names = F.create_map(*[F.lit(x) for x in ("Create", "Added", "Modify", "Modified", "Remove", "Removed")])
    out = events.withColumn("event", F.try_element_at(names, F.col("kind"))).filter("event is not null")
    return out.select("event", F.explode("paths").alias("path"), F.lit(None).cast("string").alias("origin"), "at", "seq")


def follow(spark: SparkSession, log: str, folder: str, state: str, rows_of, schema_path: str | None = None):
    """Applies new lines of the log to the stored catalog and ends when none are left.

    ``rows_of(paths)`` gives the catalog rows that added and modified paths have now. The catalog is the state: a
    batch is folded by path, so replaying it gives the same catalog. Only buckets of paths that changed are rewritten.
    """
    lines = spark.readStream.text(log)

    def apply(batch: DataFrame, _number: int) -> None:
        changes = materialise(parse_lines(batch), "changes")
        last = fold_changes(changes)
        alive = last.filter("event <> 'Removed'").select("path")
        storage.replace(folder, last.select("path"), lambda rows: apply_changes(rows, changes, rows_of(alive)))

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
