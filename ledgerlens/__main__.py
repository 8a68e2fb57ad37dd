"""Command line (for spark-submit or python -m ledgerlens).

    python -m ledgerlens prepare RAW [RAW ...] --out TABLE [--format csv|parquet]
    python -m ledgerlens report NAME [NAME ...] --table TABLE [--out DIR] [--format parquet|csv|show] [--limit N]
    python -m ledgerlens list

``prepare`` combines the raw exports by column name and writes the prepared
table once (Parquet, partitioned by year/month). ``report`` runs reports over
that table and writes each result to ``DIR/NAME``, or prints all its rows (``--limit N``: the first N).
``--cluster`` starts from the settings for a large cluster (``session.CLUSTER_CONF``). The session
comes from ``SparkSession.builder.getOrCreate()``, so master, memory and
``spark.checkpoint.dir`` are whatever spark-submit / spark-defaults provide.
"""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.catalog import REPORTS
from ledgerlens.plans.preparation import prepare_transactions
from ledgerlens.session import BASE_CONF, CLUSTER_CONF, ensure_checkpoint_dir
from ledgerlens.sources import read_raw, read_transactions, write_transactions


def _session(cluster: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName("ledgerlens")
    for k, v in (CLUSTER_CONF if cluster else BASE_CONF).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def cmd_prepare(spark: SparkSession, raw: list[str], out: str, fmt: str) -> None:
    tables = [read_raw(spark, path, fmt) for path in raw]
    write_transactions(prepare_transactions(*tables), out)


def _print_rows(df: DataFrame, limit: int | None) -> None:
    """Print as CSV, a partition at a time."""
    writer = csv.writer(sys.stdout)
    writer.writerow(df.columns)
    for row in (df if limit is None else df.limit(limit)).toLocalIterator():
        writer.writerow(row)


def cmd_report(spark: SparkSession, names: list[str], table: str, out: str | None, fmt: str, limit: int | None = None) -> None:
    txn = read_transactions(spark, table)
    for name in names:
        df = REPORTS[name](txn)
        if fmt == "show" or not out:
            print(f"== {name}")
            _print_rows(df, limit)
        else:
            df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{out.rstrip('/')}/{name}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens")
    sub = parser.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("raw", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    r = sub.add_parser("report")
    r.add_argument("names", nargs="+", choices=sorted(REPORTS) + ["all"])
    r.add_argument("--table", required=True)
    r.add_argument("--out")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv", "show"])
    r.add_argument("--limit", type=int)
    for command in (p, r):
        command.add_argument("--cluster", action="store_true")
    sub.add_parser("list")
    args = parser.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(REPORTS))
        return 0
    spark = _session(args.cluster)
    if args.cmd == "prepare":
        cmd_prepare(spark, args.raw, args.out, args.format)
    else:
        names = list(REPORTS) if "all" in args.names else args.names
        cmd_report(spark, names, args.table, args.out, args.format, args.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
