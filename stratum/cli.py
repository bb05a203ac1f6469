"""python -m stratum.cli ROOT: a prompt for scripts and dot-commands."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import PlanError
from .lang.parser import ParseFailure

HELP = """.databases, .dbs      list databases
.tables [database]    list tables
.types [database]     list types
.help, .h             this text
.quit, .q             leave
A statement ends with a semicolon and may span lines."""


def command(engine: Engine, line: str) -> bool:
    """Run a dot-command; False to leave."""
    name, *rest = line.split()
    which = rest[0] if rest else None
    if name in (".quit", ".q"):
        return False
    if name in (".help", ".h"):
        print(HELP)
    elif name in (".databases", ".dbs"):
        engine.databases().show(truncate=False)
    elif name == ".tables":
        engine.tables(which).show(truncate=False)
    elif name == ".types":
        engine.types(which).show(truncate=False)
    else:
        print(f"unknown command {name}; .help lists them")
    return True


def statements(engine: Engine, text: str) -> None:
    try:
        for result in engine.execute(text):
            if result is not None:
                result.show(truncate=False)
    except ParseFailure as failure:
        for p in failure.problems:
            print(f"{p.code} at {p.span.start}-{p.span.end}: {p.message}")
    except PlanError as error:
        for problem in error.problems:
            print(problem)


def main(root: str) -> None:
    engine = Engine(SparkSession.builder.getOrCreate(), root)
    held = ""
    while True:
        try:
            line = input("... " if held else "> ")
        except EOFError:
            return
        if not held and line.startswith("."):
            if not command(engine, line):
                return
            continue
        held += line + "\n"
        if line.rstrip().endswith(";"):
            statements(engine, held)
            held = ""


if __name__ == "__main__":
    main(sys.argv[1])
