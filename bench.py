"""Runs the headline queries and prints one JSON line with the seconds of each: the median of five warm runs.

"value" is the sum over HEADLINE, "cold" has the first runs. Queries named catalog_* run on a synthetic stored catalog of BENCH_ROWS rows, 100,000 unless
set. Queries of training text are run once after a warm-up, where the subpackage is there.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trawl.functions.columns import derived
from trawl.operators import search
from trawl.plans import dsl
from trawl.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "100000"))
RUNS = 5
AS_OF = "2024-01-31 12:00:00"
HEADLINE = ("search_keyword", "search_mixed", "search_multi_keyword", "filter_ext", "filter_path", "trigram_postings", "trigram_candidates", "index_stats", "snippet", "search_content", "mft_paths", "wal_fold", "catalog_upsert")
TEXT = ("op1_sharding", "op2_packing", "op3_toxicity", "op4_exact_dedup", "op5_near_dedup", "op6_token_counts", "op7_license_scan", "op8_decontamination", "op9_quality", "op10_chat_format")


def synthetic(spark: SparkSession, folder: str, rows: int) -> None:
    """Files named file_N in a hundred folders, of five extensions."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "txt", "md", "json", "log")]), (F.col("id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("file_"), "id", F.lit("."), ext)
    out = spark.range(rows).select("id", name.alias("name"), F.concat(F.lit("/data/dir_"), F.col("id") % 100, F.lit("/"), name).alias("path"), ext.alias("extension"), (F.col("id") * 37 % 1_000_000).alias("size"), F.lit(AS_OF).cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("content_hash"))
    derived(out).write.parquet(folder)


def timed(run, runs: int = RUNS) -> tuple[float, float]:
    """(first run, median of the others)."""
    seconds = []
    for _ in range(runs + 1):
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - start)
    return round(seconds[0], 3), round(statistics.median(seconds[1:]), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="bench-")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{home}/shared")
    synthetic(spark, f"file://{home}/catalog", ROWS)
    runs = {name: (lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    stored = spark.read.parquet(f"file://{home}/catalog")
    for name, raw in (("catalog_keyword", "file_500"), ("catalog_ext_keyword", "ext:rs file"), ("catalog_path_size_keyword", "file_7 path:/data/dir_7 size:>1000")):
        runs[name] = lambda raw=raw: search.search(stored, dsl.normalise(dsl.parse(raw)), AS_OF)
    runs["catalog_load"] = lambda: derived(stored.select("id", "name", "path", "extension", "size", "modified", "is_dir", "content_hash"))
    cold, warm = {}, {}
    for name, run in runs.items():
        cold[name], warm[name] = timed(run)
    try:
        from trawl.llm.queries import QUERIES as TEXT_QUERIES
    except ImportError:
        TEXT_QUERIES = {}
    for name in TEXT:
        if name in TEXT_QUERIES:
            cold[name], warm[name] = timed(lambda name=name: TEXT_QUERIES[name](spark, SF_DIR), 1)
    spark.stop()
    shutil.rmtree(home, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(warm[n] for n in HEADLINE), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
