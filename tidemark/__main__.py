"""python -m tidemark list | run NAME --data FOLDER --out FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans import catalogue


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="writes a query's rows as Parquet")
    run.add_argument("name", choices=sorted(catalogue.queries()))
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return
    spark = SparkSession.builder.appName(f"tidemark {args.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalogue.queries()[args.name](spark, args.data).write.parquet(args.out)


if __name__ == "__main__":
    main()
