"""Literals bound to the type of the column that they stand against.

A literal that has no meaning for its column gives None, and its comparison holds for no row,
whatever the operator.
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ip import pack_ip
from ..functions.timeparse import literal_ns
from .. import types
from .ast import Both, Compare, Predicate


_DOUBLE = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def bind(logical: str, text: str) -> Any | None:
    """The value of a literal for a logical type."""
    if logical == "ip":
        return pack_ip(text)
    if logical in ("enum", "string"):
        return text
    if logical == "double":
        return float(text) if _DOUBLE.fullmatch(text) else None
    if logical == "timestamp" and (ns := literal_ns(text)) is not None:
        return ns
    if logical == "bool" and text in ("true", "false"):
        return int(text == "true")
    if re.fullmatch("[0-9]+", text) and int(text) < 2**64:
        return int(text)
    return None


def literal(value: Any) -> Column:
    if isinstance(value, bytes):
        return F.lit(bytearray(value))
    if isinstance(value, int) and value >= 2**63:
        return F.lit(Decimal(value))
    return F.lit(value)


def compare(schema: types.Schema, leaf: Compare) -> Column:
    """The condition of one comparison; nulls never meet it, not even !=."""
    field = schema.find(leaf.column)
    column = F.col(f"`{leaf.column}`")
    values = [v for v in (bind(field.logical, t) for t in leaf.values) if v is not None]
    if not values:
        return F.lit(False)
    if field.logical == "bool":
        # Stored as 0 and 1: keep the plain column where the literal is one of these.
        if leaf.op in ("=", "in", "!=") and set(values) <= {0, 1}:
            hits = [column == F.lit(bool(v)) for v in values]
            return ~hits[0] if leaf.op == "!=" else hits[0] if len(hits) == 1 else column.isin([bool(v) for v in values])
        column = column.cast("int")
    if leaf.op == "in":
        return column.isin([literal(v) for v in values])
    value = literal(values[0])
    return {"=": column == value, "!=": column != value, "<": column < value, ">": column > value}[leaf.op]


def condition(schema: types.Schema, predicate: Predicate) -> Column:
    if isinstance(predicate, Compare):
        return compare(schema, predicate)
    left, right = condition(schema, predicate.left), condition(schema, predicate.right)
    return left & right if isinstance(predicate, Both) else left | right
