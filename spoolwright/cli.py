"""python -m spoolwright.cli update|get|info|archive|convert-month|convert-year ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from .operators.segments import info_lines
from .operators.store import LogStore, StoreError, as_json, get_across
from .session import session
from .sources.files import read_legacy, year_folders
from .streaming.ingest import convert, update


class Usage(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise SystemExit(255)


def parser() -> argparse.ArgumentParser:
    p = Usage(prog="spoolwright")
    sub = p.add_subparsers(dest="command", required=True, parser_class=Usage)
    for name, what in (("archive", "compress all segments"), ("info", "statistics of all segments")):
        sub.add_parser(name, help=what).add_argument("db")
    u = sub.add_parser("update", help="take in spool files, and remove them")
    u.add_argument("db")
    u.add_argument("paths", nargs="+")
    g = sub.add_parser("get", help="records of an identifier, as JSON, in order of time")
    g.add_argument("db")
    g.add_argument("table")
    g.add_argument("id")
    g.add_argument("years", nargs="*", help="stores below db; db itself if none is given")
    for name in ("convert-month", "convert-year"):
        c = sub.add_parser(name, help="take in legacy text logs")
        c.add_argument("db")
        c.add_argument("path")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if a.command == "get" else logging.INFO)
    spark = spark or session("spoolwright", "local[*]")
    store = LogStore(spark, a.db)
    try:
        if a.command == "update":
            for path in a.paths:
                print(json.dumps({"path": path} | update(store, path)))
        elif a.command == "get":
            stores = [LogStore(spark, f"{a.db}/{y}") for y in a.years] or [store]
            # what one identifier has is for one reader, and comes row by row
            rows = as_json(get_across(stores, a.table, a.id)).select("json").toLocalIterator()
            print(json.dumps([json.loads(r[0]) for r in rows], indent=2, ensure_ascii=False))
        elif a.command == "info":
            lines = [r.line for r in info_lines(store.info()).collect()]
            print("\n".join([*lines, f"Total storages: {len(lines)}"]))
        elif a.command == "archive":
            print(json.dumps({"archived": store.archive()}))
        elif a.command == "convert-month":
            print(json.dumps(convert(store, read_legacy(spark, a.path))))
        elif a.command == "convert-year":
            for month in year_folders(spark, a.path):
                print(json.dumps({"path": month} | convert(store, read_legacy(spark, month))))
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
