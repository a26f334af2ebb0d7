"""The shell: python -m tessera.cli PATH [-c SQL | -f FILE] [-csv | -json] [-noheader] [-timer]."""

from __future__ import annotations

import argparse
import csv
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .plans.sqlparser import split_script
from .session import Database
from .streaming import Cursor

VERSION = "1.0"
WIDEST = 60


def show(df: DataFrame, out: TextIO, style: str = "table", header: bool = True) -> int:
    """Write the rows of df as a table, CSV or lines of JSON; the number of rows."""
    if style == "json":
        n = 0
        for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            print(row[0], file=out)
            n += 1
        return n
    cursor = Cursor(df)
    if style == "csv":
        writer = csv.writer(out, lineterminator="\n")
        if header:
            writer.writerow(df.columns)
        for row in cursor:
            writer.writerow(["" if v is None else v for v in row])
    else:
        while rows := cursor.fetchmany(1000):
            cells = [["NULL" if v is None else str(v)[:WIDEST] for v in r] for r in rows]
            width = [max(map(len, c)) for c in zip(df.columns, *cells)]
            line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, width)).rstrip()
            if header:
                print(line(df.columns), "-+-".join("-" * w for w in width), sep="\n", file=out)
                header = False
            print(*map(line, cells), sep="\n", file=out)
        if header:
            print(" | ".join(df.columns), file=out)
        print(f"({cursor.rowcount} row{'s' * (cursor.rowcount != 1)})", file=out)
    return cursor.rowcount


class Shell:
    def __init__(self, spark: SparkSession, path: str, style: str = "table", header: bool = True, timer: bool = False, out: TextIO | None = None):
        self.db, self.style, self.header, self.timer, self.out = Database(spark, path), style, header, timer, out or sys.stdout

    def run(self, statement: str) -> bool:
        """Run one statement or command; False once the shell should end."""
        name, _, rest = statement.strip().rstrip(";").partition(" ")
        match name.lower():
            case ".exit" | ".quit" | ".q":
                return False
            case ".timer" | ".headers":
                setattr(self, "timer" if name == ".timer" else "header", rest.strip().lower() != "off")
            case ".mode":
                self.style = rest.strip()
            case ".output":
                self.out = open(rest.strip(), "w") if rest.strip() else sys.stdout  # noqa: SIM115
            case ".open":
                self.db = Database(self.db.spark, rest.strip())
            case ".version":
                print(VERSION, file=self.out)
            case _:
                began = time.perf_counter()
                df = self.db.exec(statement)
                if df is not None:
                    show(df, self.out, self.style, self.header)
                if self.timer:
                    print(f"{time.perf_counter() - began:.3f} s", file=self.out)
        return True

    def run_all(self, statements: Iterable[str]) -> int:
        for s in statements:
            try:
                if not self.run(s):
                    break
            except EngineError as e:
                print(f"error: {e}", file=sys.stderr)
                return 1
        return 0

    def lines(self) -> Iterable[str]:
        held = ""
        while True:
            try:
                line = input("...> " if held else "> ")
            except EOFError:
                return
            if not held and line.strip().startswith("."):
                yield line
                continue
            held += line + "\n"
            if line.rstrip().endswith(";"):
                yield from split_script(held)
                held = ""


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("path")
    p.add_argument("-c", dest="sql")
    p.add_argument("-f", dest="file")
    p.add_argument("-csv", dest="style", action="store_const", const="csv", default="table")
    p.add_argument("-json", dest="style", action="store_const", const="json")
    p.add_argument("-noheader", action="store_true")
    p.add_argument("-timer", action="store_true")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    a = p.parse_args(args)
    shell = Shell(spark or SparkSession.builder.getOrCreate(), a.path, a.style, not a.noheader, a.timer)
    if a.sql is not None:
        return shell.run_all(split_script(a.sql))
    if a.file is not None:
        with open(a.file) as f:
            return shell.run_all(split_script(f.read()))
    while True:
        if shell.run_all(shell.lines()) == 0:
            return 0


if __name__ == "__main__":
    sys.exit(main())
