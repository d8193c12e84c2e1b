"""The Python API: ``query("file.csv").sql("SELECT ...")``.

A query names its sources by path; each becomes a DataFrame under a view name of its own, and Catalyst does the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from .plans import sqltext
from .session import session
from .sources.resolve import resolve, stem
from .sources.typing import Schema

#: Names that earlier engines were chosen by; there is one engine, and all mean it.
BACKENDS = ("auto", "spark", "pandas", "python", "duckdb")
#: What a bound source can be called in a query, besides its stem.
ANY_SOURCE = "data"

_numbers = itertools.count()


class QueryResult:
    """The rows of a query, read as they are asked for; can be iterated again and again."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return (row.asDict(recursive=True) for row in self.df.toLocalIterator(prefetchPartitions=True))

    def to_list(self) -> list[dict[str, Any]]:
        return [row.asDict(recursive=True) for row in self.df.collect()]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def schema(self) -> Schema:
        return Schema.of(self.df)

    def optimizations(self) -> dict[str, list[str]]:
        """What the optimiser pushed into the scans: filters, partition filters and the columns read, a line for each scan."""
        found: dict[str, list[str]] = {"PushedFilters": [], "PartitionFilters": [], "ReadSchema": []}
        for line in self.explain().splitlines():
            name, colon, rest = line.partition(": ")
            if colon and name in found and rest.strip() not in ("", "[]"):
                found[name].append(rest.strip())
        return found

    def explain(self, mode: str = "formatted") -> str:
        """The physical plan, with what was pushed into the scans."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


class Query:
    """A session, and a source that queries can leave unnamed."""

    def __init__(self, source: str | None = None, spark: SparkSession | None = None, **options: Any):
        self.spark = spark or session()
        self.source = source
        self.options = options
        self._bound: DataFrame | None = resolve(self.spark, source, **options) if source else None

    def schema(self) -> Schema:
        if self._bound is None:
            raise ValueError("schema() needs a source")
        return Schema.of(self._bound)

    def sql(self, sql: str, backend: str = "auto") -> QueryResult:
        if backend not in BACKENDS:
            raise ValueError(f"Unknown backend '{backend}'. Known: {', '.join(BACKENDS)}")
        views: dict[str, str] = {}

        def name_of(source: str) -> str:
            if source not in views:
                views[source] = f"{stem(source)}_{next(_numbers)}"
                resolve(self.spark, source).createOrReplaceTempView(views[source])
            return views[source]

        text = sqltext.strip_comments(sql)
        if self._bound is not None:
            text = sqltext.with_source(text, ANY_SOURCE)
        text = sqltext.replace_sources(text, name_of)
        if self._bound is not None:
            own = {stem(self.source).lower(), ANY_SOURCE}
            names = sqltext.table_names(text)
            unknown = [n for n in names if n not in views.values() and not self._known(n)]
            for name in names:
                if name.lower() in own or [name] == unknown:
                    view = views[name] = f"{stem(self.source)}_{next(_numbers)}"
                    self._bound.createOrReplaceTempView(view)
                    text = sqltext.rename_table(text, name, view)
        try:
            return QueryResult(_distinct_names(self.spark.sql(sqltext.to_spark(text))))
        except ParseException as e:
            raise ValueError(f"Failed to parse SQL query: {e}") from e
        except AnalysisException as e:
            raise RuntimeError(f"Query failed: {e}") from e
        finally:
            for view in views.values():  # the plan has what they stand for
                self.spark.catalog.dropTempView(view)

    def _known(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)


def _distinct_names(df: DataFrame) -> DataFrame:
    """A name that comes again, as the right side's columns do, gets ``right_`` before it."""
    seen: set[str] = set()
    names = []
    for name in df.columns:
        while name in seen:
            name = f"right_{name}"
        seen.add(name)
        names.append(name)
    return df if names == df.columns else df.toDF(*names)


def query(source: str | None = None, spark: SparkSession | None = None, **options: Any) -> Query:
    return Query(source, spark, **options)
