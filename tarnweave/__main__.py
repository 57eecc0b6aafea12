"""Tables from the command line: python -m tarnweave --root FOLDER get|put|scan|count|rename|delete|tables …"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tarnweave.session import get_session
from tarnweave.sources.tables import TableStore


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tarnweave")
    parser.add_argument("--root", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"get": "table key column", "put": "table key column value", "scan": "table", "count": "table", "rename": "old new", "delete": "table", "tables": ""}.items():
        sub = commands.add_parser(name)
        for a in arguments.split():
            sub.add_argument(a)
        if name == "scan":
            sub.add_argument("--start")
            sub.add_argument("--end")
    a = parser.parse_args(argv)
    store = TableStore(spark or get_session(), a.root)
    if a.command == "get":
        print(store.get(a.table, a.key, a.column) or "")
    elif a.command == "put":
        store.put(a.table, a.key, a.column, a.value)
    elif a.command == "scan":
        for row in store.scan(a.table, a.start, a.end).orderBy("key").toLocalIterator():
            print(row["key"], json.dumps(row["columns"], sort_keys=True))
    elif a.command == "count":
        print(store.count(a.table))
    elif a.command == "rename":
        store.rename(a.old, a.new)
    elif a.command == "delete":
        store.delete(a.table)
    else:
        print("\n".join(store.tables()))


if __name__ == "__main__":
    main()
