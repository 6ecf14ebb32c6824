"""The registry of queries, and literal tables that Spark and SQL both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def query(sql: str | None) -> Callable:
    """Registers a function of (table reader, session, folder) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"), spark, d)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(literal, value))}]"
    if isinstance(value, str):
        plain = "'" + value.replace("'", "''") + "'"
        # control characters stand as chr(), so that the statement stays readable
        for c in "\n\r\t\x00":
            plain = plain.replace(c, f"' || chr({ord(c)}) || '")
        return f"({plain})" if "||" in plain else plain
    return repr(value)


class Rows:
    """A small table: schema as in 'a string, b long'."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.strip().split(" ", 1) for c in schema.split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def __str__(self) -> str:
        """A SELECT of the table."""
        values = ", ".join(f"({', '.join(map(literal, r))})" for r in self.rows)
        names = ", ".join(f"c{i}" for i in range(len(self.columns)))
        return f"(SELECT {', '.join(f'CAST(c{i} AS {SQL_TYPES[kind]}) AS {name}' for i, (name, kind) in enumerate(self.columns))} FROM (VALUES {values}) AS v({names}))"
