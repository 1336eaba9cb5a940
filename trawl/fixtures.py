"""Catalogs, records and change logs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.columns import derived

AS_OF = "2024-01-31 12:00:00"
BASE = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "json", "log", "bin")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    rows = d.select(F.col("doc_id").alias("id"), "lang", "source", ext.alias("extension"), F.octet_length("text").cast("long").alias("size"))
    name = F.concat("source", F.lit("_"), "id", F.lit("."), "extension")
    at = F.lit(BASE).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.pmod("id", F.lit(1200)).cast("int"))
    return rows.select("id", name.alias("name"), F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"), "extension", "size", at.alias("modified"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("content_hash"))


def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each language and source; there are few, so a window may number them."""
    from pyspark.sql import Window

    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    number = F.row_number().over(Window.orderBy("lang", "source")).cast("long") + 1_000_000_000
    return pairs.select(number.alias("id"), F.col("source").alias("name"), F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source").alias("path"), F.lit("").alias("extension"), F.lit(0).cast("long").alias("size"), F.lit(BASE).cast("timestamp_ntz").alias("modified"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("content_hash"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(file_rows(spark, sf_dir).unionByName(directory_rows(spark, sf_dir)))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog whose names hold spaces."""
    p = table(spark, sf_dir, "part")
    return derived(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), "p_name").alias("path"), F.lit("").alias("extension"), F.col("p_size").cast("long").alias("size"), F.lit(BASE).cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("content_hash")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as parent-pointer records, and suppliers below a root that is its own parent.

    The regions' parent is missing. Every tenth customer has an older record with another name and parent, too.
    """
    names = ["file_ref", "parent_ref", "name", "is_dir", "file_time", "seq"]

    def rows(name: str, ref, parent, label, is_dir: bool, seq: int) -> DataFrame:
        ticks = F.lit(133_500_000_000_000_000) + ref * F.lit(10_000_000)
        return table(spark, sf_dir, name).select(ref, parent, label, F.lit(is_dir), ticks, ref + seq).toDF(*names)

    c = F.col
    nation, customer = c("n_nationkey").cast("long") + 100, c("c_custkey").cast("long") + 10_000
    parts = [
        rows("region", c("r_regionkey").cast("long"), F.lit(-1).cast("long"), c("r_name"), True, 0),
        rows("nation", nation, c("n_regionkey").cast("long"), c("n_name"), True, 0),
        rows("customer", customer, c("c_nationkey").cast("long") + 100, c("c_name"), False, 10_000_000),
        rows("customer", customer, F.lit(0).cast("long"), F.concat(F.lit("old "), "c_name"), False, 0).filter("file_ref % 10 = 0"),
        rows("supplier", c("s_suppkey").cast("long") + 5_000_000, F.lit(5).cast("long"), F.concat("s_name", F.lit(".TXT")), False, 0),
        rows("region", F.lit(5).cast("long"), F.lit(5).cast("long"), F.lit("."), True, 0).limit(1).withColumn("name", F.lit("root")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Added").when(F.col("event_type") == "error", "Removed").otherwise("Modified")
    e = table(spark, sf_dir, "events")
    return e.select(kind.alias("event"), F.concat(F.lit("/users/"), "user_id").alias("path"), F.lit(None).cast("string").alias("origin"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("seq"))
