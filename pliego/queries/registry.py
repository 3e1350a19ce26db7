"""The registry: a query is a function (spark, sf_dir) -> DataFrame under its own name, with oracle SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_tables(body: str, tables: dict[str, str]) -> str:
    """body below WITH for those of the named tables that it needs, directly or through others; tables build on earlier ones."""
    needed, text = [], body
    for name, definition in reversed(tables.items()):
        if re.search(rf"\b{name}\b", text):
            needed.append(f"{name} AS ({definition})")
            text += f" {definition}"
    return f"WITH {', '.join(reversed(needed))} {body}" if needed else body
