"""Readers: each takes a path and gives a DataFrame; the work stays in Spark's own scans where it has one.

HTML and Markdown files hold a document for people, so the driver parses them, up to ``DOCUMENT_MB``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from io import BytesIO
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .typing import typed

#: The largest document that the driver parses.
DOCUMENT_MB = 256
#: Keys under which a JSON document's records are sought, in order; and texts that Markdown cells hold for null.
RECORD_KEYS = ("data", "records", "items", "rows", "results")
MARKDOWN_NULLS = ("", "null", "none", "n/a", "-")


def _exists(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"File not found: {path}")


def _content(spark: SparkSession, path: str) -> bytes:
    _exists(spark, path)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= DOCUMENT_MB << 20).select("content").limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"{path}: one file of at most {DOCUMENT_MB} MB is read as a document")
    return bytes(files[0]["content"])


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str = ",", sample: int | None = None, multi_line: bool = False) -> DataFrame:
    """A file with a header. Short rows are filled with nulls; rows with more cells than the header are left out.

    multi_line: quoted cells may hold line ends; a file is then one task's work, else it is split.
    """
    _exists(spark, path)
    options = {"header": "true", "sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    names = spark.read.options(**options).csv(path).columns
    extra = "_" + max([*names, ""], key=len)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra]])
    rows = spark.read.options(**options, mode="PERMISSIVE", enforceSchema="true").schema(schema).csv(path)
    return typed(rows.where(F.col(f"`{extra}`").isNull()).drop(extra), sample)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Partition columns are taken from ``key=value`` folders, also from those above the path itself."""
    _exists(spark, path)
    parts = path.split("/")
    first = next((i for i, p in enumerate(parts) if re.fullmatch(r"[^=]+=[^=]*", p)), None)
    reader = spark.read if not first else spark.read.option("basePath", "/".join(parts[:first]))
    return reader.parquet(path)


def read_jsonl(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One object a line; lines that are blank, malformed or something else are left out."""
    _exists(spark, path)
    return spark.read.option("mode", "DROPMALFORMED").option("encoding", encoding).json(path)


def read_json(spark: SparkSession, path: str, records: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A whole document: a list of records, or an object that holds them at the path ``records`` (``a.b``, ``a[0].b``,
    ``a[].b``), else under one of RECORD_KEYS, else in its first list; an object without a list is one record."""
    _exists(spark, path)
    document = spark.read.option("multiLine", "true").option("encoding", encoding).json(path)
    head = next((r["value"].strip() for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "")
    if head.startswith("["):
        if records:
            raise ValueError(f"Key '{records}' not found: the document is a list")
        return document
    if records:
        return _at(document, records)
    lists = [f.name for f in document.schema if isinstance(f.dataType, T.ArrayType)]
    key = next((k for k in RECORD_KEYS if k in lists), next((k for k in lists if isinstance(document.schema[k].dataType.elementType, T.StructType)), None))
    return document if key is None else _at(document, f"`{key}`")


def _steps(path: str) -> list[str | int | None]:
    """Names, whole numbers for places in lists, and None for all of a list."""
    steps: list[str | int | None] = []
    for part in re.findall(r"`[^`]*`|[^.`]+", path):
        if part[0] == "`":
            steps.append(part.strip("`"))
            continue
        parsed = re.fullmatch(r"([^\[\]]*)((?:\[-?\d*\])*)", part)
        if not parsed:
            raise ValueError(f"Invalid path: {path}")
        steps += [parsed[1]] if parsed[1] else []
        steps += [int(x) if x else None for x in re.findall(r"\[(-?\d*)\]", parsed[2])]
    if steps.count(None) > 1:
        raise ValueError(f"Only one [] is supported in a path: {path}")
    return steps


def _at(document: DataFrame, path: str) -> DataFrame:
    here: DataFrame = document.select(F.struct("*").alias("x"))
    for step in _steps(path):
        kind = here.schema["x"].dataType
        if isinstance(step, str):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                raise ValueError(f"Key '{step}' not found")
            here = here.select(F.col("x").getField(step).alias("x")).where("x IS NOT NULL")
        elif not isinstance(kind, T.ArrayType):
            raise ValueError(f"Expected a list in {path}")
        elif step is None:
            here = here.select(F.explode("x").alias("x")).where("x IS NOT NULL")
        else:
            if here.where(F.size("x") > (step if step >= 0 else -step - 1)).isEmpty():
                raise ValueError(f"Index {step} out of range")
            here = here.select(F.element_at("x", step + 1 if step >= 0 else step).alias("x"))
    kind = here.schema["x"].dataType
    if isinstance(kind, T.ArrayType):
        here = here.select(F.explode("x").alias("x"))
        kind = kind.elementType
    return here.select("x.*") if isinstance(kind, T.StructType) else here.select(F.col("x").alias("value"))


def read_xml(spark: SparkSession, path: str, element: str | None = None, sample: int | None = None) -> DataFrame:
    """A row for each ``element`` (else for the first tag that repeats). Attributes are ``@name``, nested elements
    ``parent.child``, an element's own text ``_text``; columns are sorted by name."""
    try:
        _exists(spark, path)
    except FileNotFoundError as e:
        raise OSError(f"there is no XML file at {path}") from e
    tag = (element or _repeating(_content(spark, path), path)).rsplit("/", 1)[-1]
    options = {"rowTag": tag, "attributePrefix": "@", "valueTag": "_text", "inferSchema": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.format("xml").options(**options).load(path)
    cells = dict(_flat(rows.schema, [], F.col))
    cells.pop("_corrupt", None)
    if not cells:
        raise ValueError(f"{path} has no element '{tag}'")
    texts = rows.select(*[cells[c].cast("string").alias(c) for c in sorted(cells)])
    return typed(texts, sample)


def _repeating(content: bytes, path: str) -> str:
    def seek(node: ET.Element) -> str | None:
        tags = [child.tag for child in node]
        twice = next((t for t in tags if tags.count(t) > 1), None)
        return twice or next((t for t in map(seek, node) if t), None)

    try:
        tag = seek(ET.parse(BytesIO(content)).getroot())
    except ET.ParseError as e:
        raise OSError(f"Failed to parse XML file {path}: {e}") from e
    if not tag:
        raise ValueError(f"no element comes twice in {path}: name the one that is a row")
    return tag


def _flat(kind: T.StructType, above: list[str], get) -> list[tuple[str, Column]]:
    """(name, column) of every leaf; of a repeated element the last one counts, of a leaf with attributes its text."""
    out = []
    for field in kind:
        at, inner = get(f"`{field.name}`"), field.dataType
        if isinstance(inner, T.ArrayType):
            at, inner = F.try_element_at(at, F.lit(-1)), inner.elementType
        if isinstance(inner, T.StructType) and all(n == "_text" or n[0] == "@" for n in inner.names) and "_text" in inner.names:
            out.append((".".join([*above, field.name]), at.getField("_text")))
        elif isinstance(inner, T.StructType):
            out += _flat(inner, [*above, field.name], lambda n, at=at: at.getField(n.strip("`")))
        else:
            out.append((".".join([*above, field.name]), at))
    return out


def _frame(spark: SparkSession, names: list[str], rows: list[list[str | None]]) -> DataFrame:
    """A table that the driver has parsed."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return typed(spark.createDataFrame([tuple(r) for r in rows], schema), None)


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        n, made = 1, name
        while made in out:
            made, n = f"{name}.{n}", n + 1
        out.append(made)
    return out


def _chosen(tables: list, table: int, path: str, kind: str) -> Any:
    if not tables:
        raise ValueError(f"{path} has no {kind} table")
    if not -len(tables) <= table < len(tables):
        raise ValueError(f"{path} has {len(tables)} {kind} tables, none at place {table}")
    return tables[table]


class _Tables(HTMLParser):
    """The rows of each table: (cells, whether all are header cells); a cell is (text, columns, rows) it spans."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list] = []
        self.open: list[list] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and (v or "").isdigit()}
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = ["", max(1, span.get("colspan", 1)), max(1, span.get("rowspan", 1)), tag == "th"]
            self.open[-1][-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


def _grid(rows: list) -> tuple[list[str], list[list[str | None]]]:
    """(names, cells) of a table with its spans filled in."""
    filled: list[list[tuple[str, bool]]] = []
    hanging: dict[int, list] = {}
    for row in rows:
        out: list[tuple[str, bool]] = []
        cells = iter(row)
        while True:
            if (over := hanging.get(len(out))) and over[1]:
                over[1] -= 1
                out.append(over[0])
                continue
            cell = next(cells, None)
            if cell is None:
                break
            text = re.sub(r"\s+", " ", cell[0]).strip()
            for _ in range(cell[1]):
                if cell[2] > 1:
                    hanging[len(out)] = [(text, cell[3]), cell[2] - 1]
                out.append((text, cell[3]))
        if out:
            filled.append(out)
    if not filled:
        return [], []
    width = max(map(len, filled))
    has_header = all(head for _, head in filled[0])
    body = filled[1:] if has_header else filled
    names = [t for t, _ in filled[0]] + [f"Unnamed: {i}" for i in range(len(filled[0]), width)] if has_header else [str(i) for i in range(width)]
    return _unique(names), [[t or None for t, _ in r] + [None] * (width - len(r)) for r in body]


def html_tables(spark: SparkSession, path: str, match: str | None = None) -> list[tuple[list[str], list[list[str | None]]]]:
    parser = _Tables()
    parser.feed(_content(spark, path).decode("utf-8", "replace"))
    tables = [rows for rows in parser.tables if rows and (match is None or re.search(match, " ".join(c[0] for r in rows for c in r)))]
    return [g for g in map(_grid, tables) if g[0]]


def read_html(spark: SparkSession, path: str, table: int = 0, match: str | None = None) -> DataFrame:
    """The n-th table (from the end, if negative) of those whose text matches."""
    return _frame(spark, *_chosen(html_tables(spark, path, match), table, path, "HTML"))


def markdown_tables(text: str) -> list[tuple[list[str], list[list[str | None]]]]:
    """The pipe tables of a text: (names, cells)."""
    lines, tables, i = text.splitlines(), [], 0
    while i + 1 < len(lines):
        names = _pipes(lines[i])
        if "|" in lines[i] and names and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and "-" in lines[i + 1]:
            i += 2
            rows = []
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                cells = [None if c.lower() in MARKDOWN_NULLS else c for c in _pipes(lines[i])]
                rows.append((cells + [None] * len(names))[: len(names)])
                i += 1
            tables.append((_unique(names), rows))
        else:
            i += 1
    return tables


def _pipes(line: str) -> list[str]:
    inner = re.sub(r"^\s*\||(?<!\\)\|\s*$", "", line.rstrip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def read_markdown(spark: SparkSession, path: str, table: int = 0) -> DataFrame:
    return _frame(spark, *_chosen(markdown_tables(_content(spark, path).decode("utf-8", "replace")), table, path, "Markdown"))
