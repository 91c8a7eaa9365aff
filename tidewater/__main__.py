"""python -m tidewater: list, info, ingest, export, delete tables; run recipes and reports."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidewater.operators import reports
from tidewater.plans import ops
from tidewater.plans.compiler import compile_chain
from tidewater.sources.store import Store, column_stats, load_csv


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    p.add_argument("--store", default="tidewater-store", help="root folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list").add_argument("source")
    for name in ("info", "delete"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("table")
    c = sub.add_parser("ingest")
    for a in ("path", "source", "table"):
        c.add_argument(a)
    c.add_argument("--mode", default="append")
    c.add_argument("--partition-by", nargs="*", default=None)
    c = sub.add_parser("export")
    for a in ("source", "table", "path"):
        c.add_argument(a)
    c = sub.add_parser("query")
    for a in ("source", "table", "recipe"):
        c.add_argument(a)
    c = sub.add_parser("insights")
    c.add_argument("report", choices=["trends", "review", "drivers"])
    for a in ("source", "table", "time"):
        c.add_argument(a)
    c.add_argument("--dims", nargs="*", default=[])
    c.add_argument("--measures", nargs="+", required=True)
    c.add_argument("--granularity", default="month")
    c.add_argument("--format", choices=["json", "markdown", "html"], default="markdown")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    match a.command:
        case "list":
            print("\n".join(store.tables(a.source)))
        case "info":
            m = store.manifest(a.source, a.table)
            if m is None:
                return 1
            print(f"version {m.version}, {len(m.folders)} folders, partitioned by {m.partition_by or '-'}")
            column_stats(store.read(a.source, a.table)).show(200, truncate=False)
        case "delete":
            return 0 if store.delete(a.source, a.table) else 1
        case "ingest":
            df = load_csv(spark, a.path) if a.path.endswith(".csv") else spark.read.parquet(a.path)
            store.ingest(df, a.source, a.table, a.mode, a.partition_by)
        case "export":
            store.read(a.source, a.table).write.parquet(a.path)
        case "query":
            with open(a.recipe) as f:
                compile_chain(store.read(a.source, a.table), ops.loads(f.read())).show(100, truncate=False)
        case "insights":
            found = getattr(reports, a.report)(store.read(a.source, a.table), a.time, a.dims, a.measures, a.granularity)
            print({"json": reports.to_json, "markdown": reports.to_markdown, "html": reports.to_html}[a.format](found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
