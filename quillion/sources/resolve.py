"""From a source string to a DataFrame: fragment first, then the suffix, then CSV."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import http, readers
from .fragments import parse_source_fragment

#: What a file's suffix says about its format; compression suffixes are looked through.
SUFFIXES = {
    ".html": "html",
    ".htm": "html",
    ".md": "markdown",
    ".markdown": "markdown",
    ".xml": "xml",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".csv": "csv",
}
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy")


def suffix_format(path: str) -> str | None:
    suffixes = [s.lower() for s in PurePosixPath(path.split("?")[0].rstrip("/")).suffixes]
    while suffixes and suffixes[-1] in COMPRESSED:
        suffixes.pop()
    return SUFFIXES.get(suffixes[-1]) if suffixes else None


def stem(source: str) -> str:
    """A name that SQL can use for the source."""
    path, _, table = parse_source_fragment(source)
    name = re.sub(r"\W+", "_", PurePosixPath(path.split("?")[0].rstrip("/")).name.split(".")[0]).strip("_") or "data"
    name = f"t_{name}" if name[0].isdigit() else name
    return name if table is None else f"{name}_" + re.sub(r"\W+", "_", str(table)).strip("_")


def resolve(spark: SparkSession, source: str, **options: Any) -> DataFrame:
    """The table that a source string names. options go to the format's reader."""
    path, kind, table = parse_source_fragment(source)
    if re.match(r"https?://", path):
        local = http.download(path, options.pop("cache_dir", None), options.pop("force_download", False))
        kind, path = kind or suffix_format(path) or http.sniffed(local), http.placed(spark, local)
    elif path.startswith("s3://"):
        path = "s3a://" + path[len("s3://") :]
    kind = kind or suffix_format(path) or "csv"
    if kind in ("html", "markdown"):
        if isinstance(table, str):
            raise ValueError(f"Table must be a number for {kind}: {table}")
        options = {"table": table or 0} | options
    elif kind == "json" and table is not None:
        options = {"records": str(table)} | options
    elif kind == "xml" and table is not None:
        options = {"element": str(table)} | options
    return getattr(readers, f"read_{kind}")(spark, path, **options)
