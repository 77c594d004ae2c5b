"""Command line: list queries, run one, export records."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import export
from .plans import CATALOG


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="waymark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    run = commands.add_parser("run", help="run a query and show or write its rows")
    run.add_argument("name", choices=sorted(CATALOG))
    run.add_argument("folder")
    run.add_argument("--out")
    out = commands.add_parser("export", help="merge and decide records of JSON files, and write the export files")
    out.add_argument("records")
    out.add_argument("folder")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(CATALOG)))
        return 0
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    if args.command == "run":
        df = CATALOG[args.name].run(spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=60)
        return 0
    records = export.read_records(spark, args.records)
    missing = {"business_name", "relationship", "geography"} - set(records.columns)
    if missing:
        print(f"{args.records}: records lack {', '.join(sorted(missing))}", file=sys.stderr)
        return 1
    decided, names = export.export_records(export.complete(records))
    export.write_exports(decided, args.folder)
    print(f"{records.count()} records, {decided.count()} businesses, {names.count()} ambiguous names")
    return 0


if __name__ == "__main__":
    sys.exit(main())
