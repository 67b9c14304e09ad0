"""Statements to DataFrames.

Everything is declared on one scan: Catalyst prunes its columns, pushes the bound comparisons down to
the Parquet readers and plans count as partial sums, top as a partial histogram under
``TakeOrderedAndProject``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import format_ip
from ..functions.timeparse import format_ns
from ..types import QueryError, Schema
from .ast import Compare, Count, Either, Rows, Statement, Top, leaves
from .binder import condition
from .parser import parse

#: Rows of a row query without a limit (or with LIMIT 0).
DEFAULT_LIMIT = 1000
#: The column that holds the order of ingestion, where a table has it.
SEQUENCE = "seq"


def check(schema: Schema, statement: Statement) -> Statement:
    """The statement, if all its columns are in the schema by exact name."""
    select = statement.select
    named = list(select.columns) if isinstance(select, Rows) else [select.column] if isinstance(select, Top) else []
    for name in named + [leaf.column for leaf in leaves(statement.where)]:
        if schema.find(name) is None:
            raise QueryError(f"unknown column {name!r}")
    return statement


def shown(logical: str, column: Column) -> Column:
    """Text of a cell; nulls stay null."""
    if logical == "timestamp":
        return format_ns(column)
    if logical == "ip":
        return format_ip(column)
    return column.cast("string")


def compile(df: DataFrame, schema: Schema, statement: Statement) -> DataFrame:
    """The typed result of a statement.

    count(*) gives ``count``; top gives the column and ``count``, by falling count, ties by the
    text of the value; both ignore LIMIT. Rows come by ``seq`` where the table has one, else in
    no stated order, DEFAULT_LIMIT of them unless a limit is given.
    """
    check(schema, statement)
    rows = df.where(condition(schema, statement.where)) if statement.where is not None else df
    select = statement.select
    if isinstance(select, Count):
        return rows.agg(F.count(F.lit(1)).alias("count"))
    if isinstance(select, Top):
        column = F.col(f"`{select.column}`")
        counts = rows.where(column.isNotNull()).groupBy(column.alias(select.column)).agg(F.count(F.lit(1)).alias("count"))
        return counts.orderBy(F.desc("count"), shown(schema.find(select.column).logical, column)).limit(select.n)
    names = select.columns or tuple(schema.names)
    if SEQUENCE in df.columns:
        rows = rows.orderBy(SEQUENCE)
    return rows.limit(statement.limit or DEFAULT_LIMIT).select(*(F.col(f"`{n}`") for n in names))


def query(df: DataFrame, schema: Schema, text: str) -> DataFrame:
    return compile(df, schema, parse(text))


def search_statement(schema: Schema, field: str, value: str, limit: int = 0) -> Statement:
    """Rows whose field holds a value; ``ip`` and ``port`` always stand for all columns of that type."""
    found = schema.of_type(field) if field in ("ip", "port") else [c for c in schema.columns if c.name == field]
    columns = [c.name for c in found]
    if not columns:
        raise QueryError(f"no column to search for {field!r}")
    where = reduce(Either, [Compare(c, "=", (value,)) for c in columns])
    return Statement(Rows(), where, limit)


def search(df: DataFrame, schema: Schema, field: str, value: str, limit: int = 0) -> DataFrame:
    return compile(df, schema, search_statement(schema, field, value, limit))


def format_result(result: DataFrame, schema: Schema) -> DataFrame:
    """All cells as text, nulls as empty text."""
    cells = []
    for name in dict.fromkeys(result.columns):
        field = schema.find(name)
        cells.append(F.coalesce(shown(field.logical if field else "uint", F.col(f"`{name}`")), F.lit("")).alias(name))
    return result.select(*cells)
