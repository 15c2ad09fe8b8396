"""A query with its SQL twin: both end in the same columns, whole numbers as long, other numbers at six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.sources.adapters import with_tables

#: Moves halves at the sixth place off the border, so that last-bit noise does not decide them.
NUDGE = 1e-9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, columns: str, tables: str = "", sql: str | None = None):
    """Registers a function as a query. columns: 'name:l name:d name:s', for long, double and string; tables: of the twin."""
    spec = [x.split(":") for x in columns.split()]

    def register(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            kinds = {"l": lambda c: F.col(f"`{c}`").cast("long"), "d": lambda c: F.round(F.col(f"`{c}`").cast("double") + NUDGE, 6) + F.lit(0.0), "s": lambda c: F.col(f"`{c}`").cast("string")}
            return make(spark, sf).select(*[kinds[k](c).alias(c) for c, k in spec])

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            kinds = {"l": 'CAST("{0}" AS BIGINT) AS "{0}"', "d": 'round(CAST("{0}" AS DOUBLE) + 1e-9, 6) + 0.0 AS "{0}"', "s": 'CAST("{0}" AS VARCHAR) AS "{0}"'}
            body = with_tables(sql, *tables.split()) if tables else sql
            SQL[name] = "SELECT " + ", ".join(kinds[k].format(c) for c, k in spec) + f" FROM ({body})"
        return make

    return register
