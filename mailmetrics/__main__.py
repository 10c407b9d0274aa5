"""Run reports as a batch job and write them out.

    python -m mailmetrics --sources s3://bucket/marketing \\
        --out s3://bucket/reports --reports campaign_stats,list_health

Reads the eight source tables (Parquet folders named like the tables, or
catalog tables with ``--catalog``), builds each report and writes it to
``<out>/<report>`` (Parquet by default).  The session comes from the
submitting environment (cluster settings).

    python -m mailmetrics --catalog marketing --views reports

stores the reports as views of the database ``reports`` instead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.catalog import REPORTS, USES_ROLLUP, build_report
from .operators.rollups import trace_rollup
from .plans.views import create_views
from .sources.tables import Sources


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="mailmetrics", description=__doc__.split("\n")[0])
    p.add_argument("--sources", help="folder holding one Parquet folder per source table")
    p.add_argument("--catalog", help="database holding the source tables (instead of --sources)")
    p.add_argument("--out", help="output folder; one sub-folder per report")
    p.add_argument("--views", help="database to store the reports in as views (with --catalog; instead of --out)")
    p.add_argument("--reports", default=",".join(REPORTS), help="comma-separated report names")
    p.add_argument("--as-of", default=None, help="clock of the re-engagement report (UTC)")
    p.add_argument("--format", default="parquet")
    p.add_argument("--mode", default="overwrite")
    p.add_argument("--no-ids", action="store_true",
                   help="leave out the row-number ids of R5, R13 and R15")
    return p.parse_args(argv)


def main(argv=None, spark: SparkSession | None = None) -> list[str]:
    args = parse_args(argv)
    names = [n for n in args.reports.split(",") if n]
    unknown = sorted(set(names) - set(REPORTS))
    if unknown:
        raise SystemExit(f"unknown reports: {unknown}")
    if bool(args.sources) == bool(args.catalog):
        raise SystemExit("give exactly one of --sources and --catalog")
    if bool(args.out) == bool(args.views) or args.views and not args.catalog:
        raise SystemExit("give exactly one of --out and --views; --views reads --catalog")
    spark = spark or SparkSession.builder.appName("mailmetrics").getOrCreate()
    if args.views:
        return create_views(spark, args.views, args.catalog, as_of=args.as_of, names=names)
    src = (Sources.from_parquet(spark, args.sources) if args.sources
           else Sources.from_catalog(spark, args.catalog))
    written = []
    # One click/cancel rollup serves seven reports: written once beside the
    # reports when more than one of them is asked for.
    rollup = None
    if len(USES_ROLLUP.intersection(names)) > 1:
        path = f"{args.out.rstrip('/')}/_trace_rollup"
        trace_rollup(src.mailing_trace).write.mode("overwrite").parquet(path)
        rollup = spark.read.parquet(path)
    for name in names:
        df = build_report(name, src, rollup=rollup, as_of=args.as_of, numbered=not args.no_ids)
        target = f"{args.out.rstrip('/')}/{name}"
        df.write.mode(args.mode).format(args.format).save(target)
        written.append(target)
    return written


if __name__ == "__main__":
    main()
