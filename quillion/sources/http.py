"""HTTP sources: downloaded once to a cache folder, then read like any file."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import urllib.request
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from ..session import shared_folder

#: Bytes that the format is told from.
HEAD = 8192
TIMEOUT_S = 60


def cache_folder() -> Path:
    return Path(os.environ.get("QUILLION_HTTP_CACHE") or Path(tempfile.gettempdir()) / "quillion-http")


def cached_path(url: str, folder: str | Path | None = None) -> Path:
    name = Path(unquote(urlparse(url).path)).name or "download"
    return Path(folder or cache_folder()) / f"{hashlib.md5(url.encode()).hexdigest()}_{name}"


def download(url: str, folder: str | Path | None = None, force: bool = False) -> Path:
    """The URL's content as a local file; kept until it is cleared."""
    place = cached_path(url, folder)
    if force or not place.exists():
        place.parent.mkdir(parents=True, exist_ok=True)
        part = place.with_name(place.name + f".{os.getpid()}.part")
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer, part.open("wb") as out:
                shutil.copyfileobj(answer, out)
        except OSError as e:
            part.unlink(missing_ok=True)
            raise OSError(f"Failed to download {url}: {e}") from e
        part.replace(place)
    return place


def placed(spark: SparkSession, local: Path) -> str:
    """Where executors can read a downloaded file: on one machine the file itself, else a copy in the folder that all share."""
    if spark.sparkContext.master.startswith("local["):
        return local.as_uri()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quillion-http/{local.name}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(local.as_uri()), place)
    return place.toString()


def clear_cache(url: str, folder: str | Path | None = None) -> None:
    cached_path(url, folder).unlink(missing_ok=True)


def clear_all_cache(folder: str | Path | None = None) -> None:
    shutil.rmtree(folder or cache_folder(), ignore_errors=True)


def sniffed(path: Path) -> str:
    """The format that a file's first bytes show."""
    with path.open("rb") as f:
        head = f.read(HEAD)
    text = head.decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    low = text.lower()
    if head[:4] == b"PAR1":
        return "parquet"
    if low.startswith("<?xml"):
        return "xml"
    if low.startswith(("<!doctype html", "<html")) or "<table" in low:
        return "html"
    if "|" in text and "---" in text:
        return "markdown"
    if text[:1] in ("{", "["):
        lines = [x for x in text.splitlines() if x.strip()]
        try:
            json.loads(lines[0])
            return "jsonl" if len(lines) > 1 and lines[0].lstrip()[0] == "{" else "json"
        except ValueError:
            return "json"
    return "csv"
