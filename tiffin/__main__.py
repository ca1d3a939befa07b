"""Command line: run catalogue jobs on a folder of tables.

    python -m tiffin list
    python -m tiffin run q06_top_restaurant_by_city --tables /data/marketplace \\
        --param as_of=2024-06-30 --out /data/reports/q06
    python -m tiffin run q02_time_slots --tpch /root/testdata/sf0.01 --show 20
    python -m tiffin report --tables /data/marketplace --out /data/reports \\
        --param as_of=2024-06-30
    python -m tiffin explain q09_cancellation_rate --tpch /root/testdata/sf0.01 --at-scale

``--tables`` reads ``customers/ restaurants/ orders/ riders/ deliveries/``
(Parquet); ``--catalog`` reads the co-bucketed catalog tables of
:mod:`tiffin.sources.catalog`; ``--tpch`` derives them from TPC-H-style inputs.  Without
``--out`` the first rows are shown.  ``--param`` overrides a job parameter,
read by that parameter's own type.  Defaults are the worksheet's literals;
with ``--tpch`` they are the parameters of the registered queries, which fit that data.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from tiffin.plans.catalog import CATALOG, parse_params, test_job

    parser = argparse.ArgumentParser(prog="python -m tiffin")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="list the job keys and their default parameters")
    run = sub.add_parser("run", help="run one job")
    run.add_argument("key", choices=sorted(CATALOG))
    src = run.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with the five tables as Parquet")
    src.add_argument("--tpch", help="folder with TPC-H-style inputs to derive them from")
    src.add_argument("--catalog", help="database written by write_catalog_tables (co-bucketed)")
    run.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    run.add_argument("--out", help="write the result here as Parquet (overwrite)")
    run.add_argument("--show", type=int, default=20, help="rows to show when not writing")
    exp = sub.add_parser("explain", help="print a job's physical plan")
    exp.add_argument("key", choices=sorted(CATALOG))
    esrc = exp.add_mutually_exclusive_group(required=True)
    esrc.add_argument("--tables")
    esrc.add_argument("--tpch")
    esrc.add_argument("--catalog")
    exp.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    exp.add_argument("--mode", default="formatted", choices=["simple", "extended", "formatted", "cost"])
    exp.add_argument("--at-scale", action="store_true",
                     help="turn off size-estimated broadcasts, as when every table is large")
    rep = sub.add_parser("report", help="run every question in one batch (shared order facts)")
    rsrc = rep.add_mutually_exclusive_group(required=True)
    rsrc.add_argument("--tables")
    rsrc.add_argument("--tpch")
    rsrc.add_argument("--catalog")
    rep.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    rep.add_argument("--out", required=True, help="folder; each result goes to <out>/<key>")
    args = parser.parse_args(argv)

    if args.command == "list":
        for key, (_, params) in CATALOG.items():
            print(key, " ".join(f"{k}={v}" for k, v in params.items()))
        return 0

    from tiffin.sources import from_tpch, read_catalog_tables, read_tables

    spark = spark or SparkSession.builder.appName(f"tiffin {args.command}").getOrCreate()
    if args.tables:
        tables = read_tables(spark, args.tables)
    elif args.catalog:
        tables = read_catalog_tables(spark, args.catalog)
    else:
        tables = from_tpch(spark, args.tpch)
    overrides = parse_params(dict(p.split("=", 1) for p in args.param))
    if args.command == "report":
        from tiffin.plans.report import report, write_report
        from tiffin.sources import Intermediates

        with Intermediates(spark) as work:
            write_report(report(tables, **overrides, work=work), args.out)
        return 0
    job, params = test_job(args.key) if args.tpch else CATALOG[args.key]
    if args.command == "explain" and args.at_scale:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = job(tables, **{**params, **overrides})
    if args.command == "explain":
        df.explain(mode=args.mode)
        return 0
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
