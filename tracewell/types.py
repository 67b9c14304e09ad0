"""Logical types and table schemas of telemetry data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MAX_COLUMNS = 4096
#: Longest line that is taken in, in bytes; no value of a line can be longer.
MAX_LINE = 4 << 20


class TracewellError(ValueError):
    """Base of the errors that this package raises for wrong input."""


class SchemaError(TracewellError):
    """A schema that breaks the rules of ``Schema.check``."""


class QueryError(TracewellError):
    """A statement that does not parse, or names a column that is not there."""


class StorageError(TracewellError):
    """A path that holds no table of this package, or an index that was not built."""


#: Spark types of the logical types. Numbers of nanoseconds are authoritative for timestamps, as
#: Spark's own keep microseconds only. ``double`` is an extension for tables from elsewhere.
LOGICAL = {
    "timestamp": T.LongType(),
    "ip": T.BinaryType(),
    "uint": T.LongType(),
    "wide": T.DecimalType(20, 0),
    "port": T.LongType(),
    "enum": T.StringType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "double": T.DoubleType(),
}


@dataclass(frozen=True)
class Column:
    name: str
    logical: str
    indexed: bool = False
    nullable: bool = False  # advice for readers; nulls are stored anywhere


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[Column, ...]
    id: int = 0
    version: int = 1

    def check(self) -> Schema:
        names = [c.name for c in self.columns]
        if not 1 <= len(names) <= MAX_COLUMNS:
            raise SchemaError(f"a schema has 1 to {MAX_COLUMNS} columns, not {len(names)}")
        if not all(names) or len(set(names)) != len(names):
            raise SchemaError("column names must be unique and not empty")
        if unknown := {c.logical for c in self.columns} - set(LOGICAL):
            raise SchemaError(f"unknown logical types: {sorted(unknown)}")
        return self

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def find(self, name: str) -> Column | None:
        """By exact, case-sensitive name."""
        return next((c for c in self.columns if c.name == name), None)

    def of_type(self, logical: str) -> list[Column]:
        return [c for c in self.columns if c.logical == logical]

    def metadata(self, column: Column) -> dict:
        """What Parquet keeps with a field: its own marks, and the schema that it belongs to."""
        return {"logical": column.logical, "indexed": column.indexed, "nullable_hint": column.nullable, "schema": self.name, "schema_id": self.id, "schema_version": self.version}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, LOGICAL[c.logical], True, self.metadata(c)) for c in self.columns])

    @classmethod
    def from_struct(cls, struct: T.StructType, name: str = "table") -> Schema:
        """From the field metadata, or from the Spark types where there is none."""
        plain = {"bigint": "uint", "int": "uint", "smallint": "uint", "tinyint": "uint", "binary": "ip", "boolean": "bool", "double": "double", "float": "double", "decimal(20,0)": "wide"}
        known = next((f.metadata for f in struct if (f.metadata or {}).get("schema")), {})
        columns = tuple(Column(f.name, (f.metadata or {}).get("logical") or plain.get(f.dataType.simpleString(), "string"), bool((f.metadata or {}).get("indexed")), bool((f.metadata or {}).get("nullable_hint"))) for f in struct)
        return cls(known.get("schema", name), columns, known.get("schema_id", 0), known.get("schema_version", 1)).check()


# The three registered table layouts.
GENERIC_FLOW = Schema(
    "generic-flow",
    (
        Column("timestamp", "timestamp"),
        Column("srcip", "ip", indexed=True),
        Column("dstip", "ip", indexed=True),
        Column("srcport", "port"),
        Column("dstport", "port", indexed=True),
        Column("protocol", "enum", indexed=True),
        Column("asn", "uint", indexed=True),
        Column("country", "enum", indexed=True, nullable=True),
        Column("eventtype", "enum", indexed=True),
        Column("bytes", "uint"),
        Column("packets", "uint"),
    ),
    id=1,
).check()
HONEYPOT = Schema(
    "honeypot",
    (
        Column("timestamp", "timestamp"),
        Column("srcip", "ip", indexed=True),
        Column("srcport", "port"),
        Column("dstport", "port", indexed=True),
        Column("protocol", "enum", indexed=True),
        Column("eventtype", "enum", indexed=True),
        Column("username", "string", indexed=True, nullable=True),
        Column("password", "string", nullable=True),
        Column("country", "enum", indexed=True, nullable=True),
        Column("asn", "uint", indexed=True),
    ),
    id=2,
).check()
WEB_ACCESS = Schema(
    "web-access",
    (
        Column("timestamp", "timestamp"),
        Column("srcip", "ip", indexed=True),
        Column("method", "enum", indexed=True),
        Column("path", "string", indexed=True),
        Column("status", "uint", indexed=True),
        Column("bytes", "uint"),
        Column("referer", "string", nullable=True),
        Column("useragent", "string", indexed=True, nullable=True),
    ),
    id=3,
).check()
SCHEMAS = {s.name: s for s in (GENERIC_FLOW, HONEYPOT, WEB_ACCESS)}
