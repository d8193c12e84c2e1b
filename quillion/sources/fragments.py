"""Source strings: a path or URL, then optionally ``#format:table``."""

from __future__ import annotations

#: The formats that a fragment can name.
FORMATS = ("csv", "parquet", "html", "markdown", "json", "jsonl", "xml")


class FragmentParseError(Exception):
    """A fragment that names no known format, or an empty table."""


def parse_source_fragment(source: str) -> tuple[str, str | None, int | str | None]:
    """(path, format or None, table or None); the last ``#`` begins the fragment, and a whole number is a table's place."""
    path, mark, fragment = source.rpartition("#")
    if not mark:
        return source, None, None
    kind, colon, table = fragment.partition(":")
    kind = kind.strip()
    if kind and kind not in FORMATS or not kind and not colon and fragment:
        raise FragmentParseError(f"'{kind}' is no format that can be read; these are: {', '.join(FORMATS)}")
    if not colon:
        return path, kind or None, None
    if not table.strip():
        raise FragmentParseError("a table's name or place must follow the colon")
    try:
        return path, kind or None, int(table)
    except ValueError:
        return path, kind or None, table


def build_source_fragment(source: str, format: str | None = None, table: int | str | None = None) -> str:
    """The inverse of parse_source_fragment."""
    tail = (format or "") + ("" if table is None else f":{table}")
    return f"{source}#{tail}" if tail else source
