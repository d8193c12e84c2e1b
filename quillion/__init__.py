"""Quillion: a file analytics engine that runs on Spark SQL."""

from .api import Query, QueryResult, query

__version__ = "0.1.0"
__all__ = ["Query", "QueryResult", "__version__", "query"]
