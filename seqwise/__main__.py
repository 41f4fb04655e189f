"""Command line: list registered queries or run one and write its result.

    python -m seqwise list
    python -m seqwise explain window_features --data /path/to/tables
    python -m seqwise run window_features --data /path/to/tables --out /path/to/result [--master local[8]]

On a cluster, submit with spark-submit (the session then comes from the
cluster configuration and ``--master`` is omitted).
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="seqwise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    ex = sub.add_parser("explain", help="print the formatted physical plan of a query")
    ex.add_argument("name")
    ex.add_argument("--data", required=True)
    ex.add_argument("--master", default="local[8]")
    run = sub.add_parser("run", help="run a registered query and write Parquet")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder with <table>.parquet inputs")
    run.add_argument("--out", required=True, help="output folder (overwritten)")
    run.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    run.add_argument("--files", type=int, default=None, help="bound the number of output files")
    args = ap.parse_args(argv)

    from seqwise.plans.registry import all_queries
    queries = all_queries()
    if args.cmd == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.name not in queries:
        print(f"unknown query {args.name}", file=sys.stderr)
        return 2
    if args.cmd == "explain":
        from seqwise.session import build_session
        queries[args.name](build_session(master=args.master), args.data).explain("formatted")
        return 0
    if args.master:
        from seqwise.session import build_session
        spark = build_session(master=args.master)
    else:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.getOrCreate()
    df = queries[args.name](spark, args.data)
    if args.files:
        df = df.repartition(args.files)
    df.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
