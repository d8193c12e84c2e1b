"""The command line: ``python -m quillion query [FILE] SQL`` and ``python -m quillion shell [FILE]``."""

from __future__ import annotations

import argparse
import shutil
import sys
import time
from pathlib import Path

from . import __version__, sinks
from .api import BACKENDS, Query


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillion", description="SQL over files, on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run one query")
    q.add_argument("file_or_sql", nargs="?")
    q.add_argument("sql", nargs="?")
    q.add_argument("--sql-file", "-q", type=Path)
    q.add_argument("--format", "-f", choices=list(sinks.FORMATTERS))
    q.add_argument("--backend", "-b", choices=BACKENDS, default="auto")
    q.add_argument("--limit", "-l", type=int, help="rows shown at most")
    q.add_argument("--output", "-o", help="write to a file; .parquet writes a folder in parallel")
    q.add_argument("--no-color", action="store_true", help="accepted; output has no colour")
    q.add_argument("--explain", action="store_true")
    q.add_argument("--time", "-t", action="store_true")
    q.add_argument("--interactive", "-i", action="store_true", help="page through the result")
    q.add_argument("--no-interactive", action="store_true")
    s = commands.add_parser("shell", help="read queries line by line")
    s.add_argument("file", nargs="?")
    s.add_argument("--history-file", type=Path)
    s.add_argument("--incognito", action="store_true")
    return top


def _given(args: argparse.Namespace) -> tuple[str | None, str]:
    """(source, SQL)."""
    if args.sql_file:
        return args.file_or_sql, args.sql_file.read_text()
    if args.sql is not None:
        return args.file_or_sql, args.sql
    if args.file_or_sql is None:
        raise ValueError("No SQL query given")
    return None, args.file_or_sql


def _overflows(text: str) -> bool:
    """Whether a terminal has no room for the text, which is then paged."""
    if not sys.stdout.isatty():
        return False
    wide, high = shutil.get_terminal_size()
    lines = text.splitlines()
    return len(lines) > high or any(len(line) > wide for line in lines)


def run_query(args: argparse.Namespace) -> None:
    source, sql = _given(args)
    began = time.perf_counter()
    result = Query(source).sql(sql, backend=args.backend)
    if args.explain:
        print(result.explain())
        return
    if args.output and args.output.lower().endswith(".parquet"):
        sinks.write(result.df, args.output, "parquet", "overwrite")
        print(f"Results written to {args.output}")
        return
    if args.limit is not None and args.limit < 0:
        raise ValueError("--limit must not be negative")
    rows = [r.asDict(recursive=True) for r in (result.df if args.limit is None else result.df.limit(args.limit)).collect()]
    kind = args.format or (sinks.FILES.get(Path(args.output).suffix.lower(), "table") if args.output else "table")
    text = sinks.get_formatter(kind)(rows)
    if args.output:
        Path(args.output).write_text(text, encoding="utf-8")
        print(f"Results written to {args.output}")
    elif not args.no_interactive and (args.interactive or kind == "table" and _overflows(text)):
        import pydoc

        pydoc.pager(text)
    else:
        print(text)
    if args.time:
        print(f"Execution time: {time.perf_counter() - began:.3f} s", file=sys.stderr)


def run_shell(args: argparse.Namespace) -> None:
    engine = Query(args.file)
    history = [] if args.incognito or not args.history_file else [args.history_file]
    lines: list[str] = []
    while True:
        try:
            lines.append(input("quillion> " if not lines else "      ...> "))
        except EOFError:
            break
        text = "\n".join(lines).strip()
        if text.lower() in ("exit", "quit", ".exit", ".quit"):
            break
        if not text.endswith(";") and text:
            continue
        lines = []
        if not text:
            continue
        for path in history:
            with path.open("a") as f:
                f.write(text.replace("\n", " ") + "\n")
        try:
            print(sinks.as_table(engine.sql(text).to_list()))
        except Exception as e:  # the next query may do better
            print(f"Error: {e}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        (run_query if args.command == "query" else run_shell)(args)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
