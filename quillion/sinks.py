"""Sinks: rows as text for people and programs, and files written by Spark."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Callable
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame

Rows = list[dict[str, Any]]
#: Columns of a text table are cut at so many characters.
WIDTH = 30


def _plain(value: Any) -> Any:
    """JSON has neither infinities nor dates."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _count(n: int) -> str:
    return f"{n} row{'' if n == 1 else 's'}"


def as_table(rows: Rows, show_footer: bool = True, width: int = WIDTH, **_: Any) -> str:
    if not rows:
        return "No results found."

    def cut(value: Any) -> str:
        text = "NULL" if value is None else str(value).replace("\n", " ")
        return text if len(text) <= width else text[: width - 1] + "…"

    lines = [[str(c) for c in rows[0]], *([cut(v) for v in r.values()] for r in rows)]
    sizes = [max(map(len, column)) for column in zip(*lines)]
    rule = "+" + "+".join("-" * (s + 2) for s in sizes) + "+"
    drawn = ["|" + "|".join(f" {c:<{s}} " for c, s in zip(line, sizes)) + "|" for line in lines]
    out = "\n".join([rule, drawn[0], rule, *drawn[1:], rule])
    return out + (f"\n{_count(len(rows))}" if show_footer else "")


def as_json(rows: Rows, compact: bool = False, **_: Any) -> str:
    shape: dict[str, Any] = {"separators": (",", ":")} if compact else {"indent": 2}
    return json.dumps(_plain(rows), default=str, ensure_ascii=False, **shape)


def as_csv(rows: Rows, delimiter: str = ",", quote_all: bool = False, **_: Any) -> str:
    if not rows:
        return ""
    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]), delimiter=delimiter, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def as_markdown(rows: Rows, show_footer: bool = True, align: str | dict[str, str] = "left", **_: Any) -> str:
    if not rows:
        return "_No results found._"
    rules = {"left": ":---", "center": ":---:", "right": "---:"}
    names = list(rows[0])
    cell = lambda v: "_NULL_" if v is None else str(v).replace("|", "\\|") if isinstance(v, str) else str(v)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    way = lambda c: align if isinstance(align, str) else align.get(c, "left")
    out = "\n".join([line(names), line(rules.get(way(c), rules["left"]) for c in names), *(line(map(cell, r.values())) for r in rows)])
    return out + (f"\n\n_{_count(len(rows))}_" if show_footer else "")


FORMATTERS: dict[str, Callable[..., str]] = {"table": as_table, "json": as_json, "csv": as_csv, "markdown": as_markdown}


def get_formatter(name: str) -> Callable[..., str]:
    if name.lower() not in FORMATTERS:
        raise ValueError(f"Unknown format '{name}'. Available formats: {', '.join(FORMATTERS)}")
    return FORMATTERS[name.lower()]


#: Formats of files, by suffix.
FILES = {".json": "json", ".csv": "csv", ".md": "markdown", ".markdown": "markdown", ".txt": "table"}


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "error") -> None:
    """The whole result, in parallel, as a folder of parquet, csv or json files."""
    kind = format or PurePath(path).suffix.lstrip(".").lower()
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"Cannot write format '{kind}': parquet, csv or json")
    writer = df.write.mode(mode)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)
