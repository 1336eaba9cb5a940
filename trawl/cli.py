"""Command line: python -m trawl.cli [--folder F] init | rebuild | scan DIR | search QUERY | stats."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trawl.catalog import Catalog
from trawl.config import Config
from trawl.operators.catalog_ops import json_line, text_line


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trawl")
    parser.add_argument("--folder", default=".trawl")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "rebuild", "stats"):
        sub.add_parser(name)
    sub.add_parser("scan").add_argument("directory")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=50)
    find.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("trawl").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, args.folder)
    if args.command == "init":
        Config.init(catalog.config_path)
    elif args.command == "rebuild":
        catalog.rebuild().show(truncate=False)
    elif args.command == "scan":
        catalog.upsert_scan(args.directory).show(truncate=False)
        if all(d["path"] != args.directory for d in catalog.config.directories):
            catalog.add_directory(args.directory)
    elif args.command == "stats":
        catalog.stats().show(truncate=False)
    else:
        out = catalog.search(args.query, limit=args.limit)
        if args.json:
            print("\n".join(r[0] for r in out.select(json_line()).collect()))
        else:
            for rank, row in enumerate(out.select(text_line()).collect(), 1):
                print(f"{rank:4d}  {row[0]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
