"""Adapters: a line of a known log format to a typed record.

An adapter's ``rows`` makes, on a worker, a function from lines to tuples of its schema's values, or None where
a line is to be skipped. A bad field inside a good line is null; no line fails a job. Lines are decoded an
Arrow batch at a time (``decoders``), without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import GENERIC_FLOW, HONEYPOT, WEB_ACCESS, Schema, TracewellError
from . import decoders

cloudpickle.register_pickle_by_value(decoders)  # workers need not have this package


@dataclass(frozen=True)
class Adapter:
    name: str
    schema: Schema
    rows: Callable[[Schema], Callable[[], Callable]]  # for a schema: what a worker calls for its function from lines to tuples


_registry: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    _registry[adapter.name] = adapter
    return adapter


def get(name: str, wide: bool = False) -> Adapter:
    """The adapter of a source; ``wide`` keeps its unsigned numbers up to 2^64 as decimals, else those from 2^63 on are null."""
    if name not in _registry:
        raise TracewellError(f"unknown source {name!r}; known: {', '.join(names())}")
    found = _registry[name]
    if not wide:
        return found
    columns = tuple(replace(c, logical="wide") if c.logical == "uint" else c for c in found.schema.columns)
    return replace(found, schema=replace(found.schema, columns=columns).check())


def names() -> list[str]:
    return sorted(_registry)


# The keys that each format may use for a column; the first one present wins.
FLOW_KEYS = {
    "timestamp": ("timestamp", "ts", "@timestamp"),
    "srcip": ("srcip", "src_ip", "saddr"),
    "dstip": ("dstip", "dst_ip", "daddr"),
    "srcport": ("srcport", "src_port", "sport"),
    "dstport": ("dstport", "dst_port", "dport"),
    "protocol": ("protocol", "proto"),
    "asn": ("asn", "src_asn"),
    "country": ("country", "geoip_country", "src_country"),
    "eventtype": ("eventtype", "event_type", "event"),
    "bytes": ("bytes", "in_bytes", "orig_bytes"),
    "packets": ("packets", "in_pkts"),
}
HONEYPOT_KEYS = {
    "timestamp": ("timestamp", "ts", "@timestamp", "eventtime"),
    "srcip": ("srcip", "src_ip", "peerIP", "src_host"),
    "srcport": ("srcport", "src_port", "peerPort"),
    "dstport": ("dstport", "dst_port", "hostPort"),
    "protocol": ("protocol", "proto", "service"),
    "eventtype": ("eventtype", "event_type", "event"),
    "username": ("username", "user"),
    "password": ("password", "pass"),
    "country": ("country", "geoip_country"),
    "asn": ("asn", "src_asn"),
}


#: Arrow types of a record's fields by logical type.
_ARROW = {"timestamp": pa.int64(), "ip": pa.binary(), "uint": pa.int64(), "wide": pa.decimal128(20, 0), "port": pa.int64(), "enum": pa.string(), "string": pa.string()}


def _limits(schema: Schema) -> dict[str, int]:
    return {c.name: 1 << 64 for c in schema.columns if c.logical == "wide"}


def _json(keys: dict[str, tuple[str, ...]]) -> Callable[[Schema], Callable]:
    def of(schema: Schema) -> Callable:
        kinds = {"port": "uint", "wide": "uint"}
        fields, limits = [(c.name, kinds.get(c.logical, c.logical)) for c in schema.columns], _limits(schema)
        return lambda: decoders.json_rows(fields, keys, limits)

    return of


def _web(schema: Schema) -> Callable:
    limits = _limits(schema)
    return lambda: decoders.web_rows(limits)


register(Adapter("generic-flow", GENERIC_FLOW, _json(FLOW_KEYS)))
register(Adapter("honeypot", HONEYPOT, _json(HONEYPOT_KEYS)))
register(Adapter("web-access", WEB_ACCESS, _web))


def decode_lines(lines: DataFrame, source: str, column: str = "value", wide: bool = False, numbered: bool = False) -> DataFrame:
    """``record`` (null where a line is skipped) after the columns of ``lines``; a null line is skipped.

    ``numbered`` adds ``seq`` to a stream's lines: numbers that rise from batch to batch.
    """
    adapter = get(source, wide)
    struct = adapter.schema.struct()
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in struct])
    out = T.StructType([*lines.schema.fields, T.StructField("record", plain), *([T.StructField("seq", T.LongType())] if numbered else [])])
    fields = [(c.name, _ARROW[c.logical]) for c in adapter.schema.columns]
    return lines.mapInArrow(decoders.decoder(adapter.rows(adapter.schema), lines.columns.index(column), fields, numbered), out)


def records(lines: DataFrame, source: str, column: str = "value", wide: bool = False) -> DataFrame:
    """The typed records of the lines that are not skipped, with field metadata."""
    kept = decode_lines(lines.select(column), source, column, wide).where("record is not null").select("record.*")
    fields = {f.name: f.metadata for f in get(source, wide).schema.struct()}
    return kept.select(*(F.col(f"`{n}`").alias(n, metadata=m) for n, m in fields.items()))
