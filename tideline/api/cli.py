"""Command line: run one expression over a folder of tables or a stored table."""

from __future__ import annotations

import argparse
import sys

from ..errors import BadQuery, ExecutionError
from .engine import Engine
from .format import FORMATS, parse_duration, parse_time


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline", description=__doc__)
    p.add_argument("expr", nargs="?", help="expression; standard input if left out")
    p.add_argument("-q", "--query")
    p.add_argument("--table", help="folder of the stored layout")
    p.add_argument("--tables", help="folder of the demonstration tables")
    p.add_argument("--time", default="now")
    p.add_argument("--start")
    p.add_argument("--end", default="now")
    p.add_argument("--step", default="60s")
    p.add_argument("--format", choices=[*FORMATS, "plan"], default="table")
    p.add_argument("--explain", action="store_true", help="print the physical plan and do not run it")
    return p


def run(args: argparse.Namespace, engine: Engine) -> str:
    expr = args.query or args.expr or sys.stdin.read().strip()
    if not expr:
        raise BadQuery("no expression")
    if args.start:
        start, end, step = parse_time(args.start), parse_time(args.end), parse_duration(args.step)
    else:
        start = end = parse_time(args.time)
        step = 0
    if args.explain or args.format == "plan":
        return engine.explain(expr, start, end, step)
    result = engine.query_range(expr, start, end, step) if args.start else engine.query(expr, end)
    return FORMATS[args.format](result)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.table:
        from ..sources.ingest import Table

        engine = Engine(spark, Table(spark, args.table).store())
    else:
        from ..plans import demo

        engine = demo.engine(spark, args.tables or ".")
    try:
        sys.stdout.write(run(args, engine))
    except (BadQuery, ExecutionError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
