"""Command line: generate if missing, sort without duplicates, and check. ``python -m recordflow.cli -c N -s SIZE``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .costmodel import check_sizes
from .functions.text import ok_bad, short_number
from .operators.sorting import sort_distinct
from .operators.verify import is_sound, verify_integrity, verify_order
from .report import Monitor, Report, log, observed
from .shared import hadoop_path
from .sources.generate import open_or_generate
from .sources.records import read_text_records, write_records
from .spec import RecordSpec, Settings


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="recordflow", description=__doc__)
    p.add_argument("-c", "--count", type=int, required=True, help="number of records")
    p.add_argument("-s", "--size", type=int, default=1024, help="bytes of a record")
    p.add_argument("-o", "--trace", default=None, help="file for the trace; stderr if none")
    p.add_argument("-v", "--verify", action="store_true", help="check order and contents after the sort")
    p.add_argument("-vo", "--verify-only", action="store_true", help="check existing output only")
    p.add_argument("--input", default=None, help="folder of the input; it is generated if missing")
    p.add_argument("--output", default=None, help="folder of the output")
    p.add_argument("--seed", type=int, default=100)
    p.add_argument("--monitor", type=float, default=0, metavar="SECONDS", help="note memory and tasks so often, in the report")
    p.add_argument("--mode", choices=["range", "hash", "adjacent"], default="range")
    return p.parse_args(argv)


def verify(spark: SparkSession, args: argparse.Namespace, spec: RecordSpec, report: Report) -> bool:
    sound = True
    with report.timed("verify_order"):
        order = verify_order(spark, args.output, spec)
        report.findings["order"] = order.first().asDict()
        sound &= is_sound(order)
    with report.timed("verify_integrity"):
        both = verify_integrity(read_text_records(spark, args.output, spec), read_text_records(spark, args.input, spec))
        report.findings["integrity"] = both.first().asDict()
        sound &= is_sound(both)
    log.info("verification: %s", ok_bad(sound))
    return sound


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.count < 0:
        raise SystemExit("the number of records can't be negative")
    spec = RecordSpec(args.size)
    check_sizes(Settings(record_size=args.size))
    args.input = args.input or f"input-c{args.count}-s{args.size}"
    args.output = args.output or f"output-c{args.count}-s{args.size}"
    logging.basicConfig(filename=args.trace, level=logging.INFO, format="%(message)s", force=True)
    spark = spark or SparkSession.builder.appName("recordflow").getOrCreate()
    report = Report()
    with Monitor(spark, args.monitor) as monitor:
        status = run(spark, args, spec, report)
    if monitor.samples:
        report.findings["monitor"] = monitor.summary()
    log.info("%s", report.as_json())
    return status


def run(spark: SparkSession, args: argparse.Namespace, spec: RecordSpec, report: Report) -> int:
    if args.verify_only:
        for name in (args.input, args.output):
            p, fs = hadoop_path(spark, name)
            if not fs.exists(p):
                log.error("%s does not exist", name)
                return 2
    else:
        with report.timed("input"):
            source = open_or_generate(spark, args.input, args.count, spec, args.seed)
        with report.timed("sort"):
            out, n_out = observed(sort_distinct(source, "rec", mode=args.mode), "output")
            write_records(out, args.output)
        n_input, n_output = source.count(), n_out.get["n_rows"]  # an observation of the input would count again what range cuts sample
        report.sorted_rows(n_input, n_output)
        log.info("sorted %s records, removed %s duplicates", short_number(n_input), n_input - n_output)
        if n_input != args.count:
            log.error("the sort took %s records in, not the %s asked for", n_input, args.count)
            return 3
    sound = verify(spark, args, spec, report) if args.verify or args.verify_only else True
    return 0 if sound else 1


if __name__ == "__main__":
    sys.exit(main())
