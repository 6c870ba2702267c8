"""Command line: ``python -m chronoloom -d DIR add|delete|compact|read``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .sources.compact import compact
from .sources.lines import add_lines, iterate_lines, read_parallel, spooled
from .sources.store import Database


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoloom")
    p.add_argument("-d", "--dir", required=True)
    sub = p.add_subparsers(dest="verb", required=True)
    add = sub.add_parser("add")
    add.add_argument("-f", "--format", required=True)
    add.add_argument("--timestamp-format")
    delete = sub.add_parser("delete")
    read = sub.add_parser("read")
    for verb in (delete, read):
        verb.add_argument("filter", nargs="?")
        for name in ("--after-key", "--before-key", "--after-time", "--before-time"):
            verb.add_argument(name)
    delete.add_argument("--time")
    squeeze = sub.add_parser("compact")
    squeeze.add_argument("-M", "--major", action="store_true")
    squeeze.add_argument("--gegnum")
    squeeze.add_argument("--timestamp-format")
    read.add_argument("--print-format", action="store_true")
    stamp = read.add_mutually_exclusive_group()
    stamp.add_argument("--timestamp-format", default="%F %T")
    stamp.add_argument("--timestamp-nanos", action="store_true")
    stamp.add_argument("--timestamp-seconds", action="store_true")
    read.add_argument("--parallel")
    read.add_argument("-C", "--columns")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, lines=None, out=None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("chronoloom").getOrCreate()
    db, out = Database(spark, a.dir), out or sys.stdout
    times = {"after_key": a.after_key, "before_key": a.before_key, "after_time": a.after_time, "before_time": a.before_time} if a.verb in ("read", "delete") else {}
    if a.verb == "add":
        given = (f"{x.rstrip(chr(10))}\n".encode() for x in lines) if lines is not None else iter(lambda: sys.stdin.buffer.read(1 << 20), b"")
        with spooled(db, given) as found:
            add_lines(db, found, a.format, a.timestamp_format)
    elif a.verb == "delete":
        db.delete(a.filter, time=a.time, **times)
    elif a.verb == "compact":
        compact(db, a.major, command=a.gegnum, time_format=a.timestamp_format)
    else:
        mode = "nanos" if a.timestamp_nanos else "seconds" if a.timestamp_seconds else a.timestamp_format
        how = {"time": mode, "show_format": a.print_format, "columns": a.columns}
        if a.parallel:
            found = (r.value for r in read_parallel(db.snapshot(), a.parallel, rendered=how, pattern=a.filter, **times).toLocalIterator())
        else:
            found = iterate_lines(db.snapshot().read(a.filter, **times), **how)
        for x in found:
            print(x, file=out)


if __name__ == "__main__":
    main()
