"""What is known of each segment, and which segments a statement can do without."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import Both, Compare, Predicate, Rows, Statement, leaves
from ..plans.binder import bind, condition, literal
from ..plans.compiler import check, shown
from ..types import Schema
from .store import SEGMENT_ROWS


def segment_of(segment_rows: int = SEGMENT_ROWS, seq: str = "seq") -> Column:
    return F.expr(f"`{seq}` div {segment_rows}").alias("segment_id")


def segment_catalog(df: DataFrame, schema: Schema, segment_rows: int = SEGMENT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """A row per segment: segment_id, rows, and for each column its non-null count, minimum and maximum (``c__n``, ``c__min``, ``c__max``)."""
    names = columns or schema.names
    stats = [s for n in names for s in (F.count(f"`{n}`").alias(f"{n}__n"), F.min(f"`{n}`").alias(f"{n}__min"), F.max(f"`{n}`").alias(f"{n}__max"))]
    return df.groupBy(segment_of(segment_rows)).agg(F.count("*").alias("rows"), *stats)


def zone_map(df: DataFrame, schema: Schema, segment_rows: int = SEGMENT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The catalog for reading: a row per segment and column with rows, non_null, has_nulls and the bounds as text."""
    names = columns or schema.names
    wide = segment_catalog(df, schema, segment_rows, names)
    entry = lambda n: F.struct(F.lit(n).alias("column"), F.col(f"{n}__n").alias("non_null"), shown(schema.find(n).logical, F.col(f"{n}__min")).alias("min_value"), shown(schema.find(n).logical, F.col(f"{n}__max")).alias("max_value"))
    long = wide.select("segment_id", "rows", F.explode(F.array(*(entry(n) for n in names))).alias("e"))
    return long.select("segment_id", "e.column", "rows", "e.non_null", (F.col("e.non_null") < F.col("rows")).alias("has_nulls"), "e.min_value", "e.max_value")


def time_span(df: DataFrame, schema: Schema, segment_rows: int | None = None) -> DataFrame:
    """min_ts and max_ts (nanoseconds) of the first timestamp column, over all rows or by segment."""
    at = F.col(f"`{schema.of_type('timestamp')[0].name}`")
    grouped = df.groupBy(segment_of(segment_rows)) if segment_rows else df.groupBy()
    return grouped.agg(F.min(at).alias("min_ts"), F.max(at).alias("max_ts"))


def info(df: DataFrame, schema: Schema, segment_rows: int = SEGMENT_ROWS) -> dict:
    """Rows, columns, segments and time span of a table: one aggregate that reads ``seq`` and one column.

    Segments are those of ``zone_map``: numbers of ``seq div segment_rows`` that occur. A table without
    ``seq`` counts as if its rows were numbered.
    """
    stamps = schema.of_type("timestamp")
    at = F.col(f"`{stamps[0].name}`") if stamps else F.lit(None).cast("bigint")
    stats = [F.count("*").alias("rows"), F.min(at).alias("a"), F.max(at).alias("b")]
    if "seq" in df.columns:
        row = df.groupBy(segment_of(segment_rows)).agg(*stats).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("segments")).first()
    else:
        row = df.agg(*stats, F.ceil(F.count("*") / segment_rows).alias("segments")).first()
    return {"schema": schema.name, "rows": row["rows"], "columns": len(schema.columns), "segments": row["segments"], "min_ts": row["a"], "max_ts": row["b"]}


def _droppable(schema: Schema, leaf: Compare, at: dict[tuple[str, str], str]) -> Column:
    """Whether a comparison alone shows, without a read, that a segment has no match.

    Only equality does: by a literal without meaning, by bounds, or by membership on an indexed
    column. Other comparisons always read.
    """
    if leaf.op not in ("=", "in"):
        return F.lit(False)
    field, n = schema.find(leaf.column), leaf.column
    out = []
    for text in leaf.values:
        value = bind(field.logical, text)
        if value is None:
            out.append(F.lit(True))
            continue
        low, high = (F.col(f"{n}__{e}") if field.logical != "bool" else F.col(f"{n}__{e}").cast("int") for e in ("min", "max"))
        outside = (F.col(f"{n}__n") > 0) & ((literal(value) < low) | (literal(value) > high))
        absent = ~F.col(at[n, text]) if field.indexed else F.lit(False)
        out.append(outside | absent)
    return reduce(Column.__and__, out)


def prune_report(df: DataFrame, schema: Schema, statement: Statement, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A row per segment: segment_id, rows, matched, pruned.

    A segment is pruned if it has no match and no comparison had to read it; AND and OR both
    evaluate both sides, so every comparison must be able to drop it. Where row filters use an
    index, membership is exact here. One aggregate over the columns that the predicate names.
    """
    check(schema, statement)
    found = leaves(statement.where)
    names = list(dict.fromkeys(leaf.column for leaf in found))
    flags: dict[tuple[str, str], str] = {}
    aggregates = []
    for leaf in found:
        field = schema.find(leaf.column)
        for text in leaf.values if leaf.op in ("=", "in") and field.indexed else ():
            if (leaf.column, text) not in flags and bind(field.logical, text) is not None:
                flags[leaf.column, text] = f"_m{len(flags)}"
                hit = condition(schema, Compare(leaf.column, "=", (text,)))
                aggregates.append(F.coalesce(F.bool_or(hit), F.lit(False)).alias(flags[leaf.column, text]))
    stats = [s for n in names for s in (F.count(f"`{n}`").alias(f"{n}__n"), F.min(f"`{n}`").alias(f"{n}__min"), F.max(f"`{n}`").alias(f"{n}__max"))]
    where = condition(schema, statement.where) if statement.where is not None else F.lit(True)
    wide = df.groupBy(segment_of(segment_rows)).agg(F.count("*").alias("rows"), F.count(F.when(where, F.lit(1))).alias("matched"), *stats, *aggregates)
    dropped = reduce(Column.__and__, [_droppable(schema, leaf, flags) for leaf in found]) if found else F.lit(False)
    return wide.select("segment_id", "rows", "matched", ((F.col("matched") == 0) & dropped).alias("pruned"))


#: Segments whose matches are added up in one task; the groups' own sums are added up in another.
GROUP = 4096


def prune_counts(df: DataFrame, schema: Schema, statement: Statement, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """pruned and scanned segments of a statement; both 0 for count(*) without WHERE, which reads nothing.

    A row query counts segments only up to the one in which its limit is reached. The running sum over
    segments goes in two steps, within groups of GROUP segments and over the groups, so no task holds all.
    """
    if statement.where is None and not isinstance(statement.select, Rows):
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("pruned"), F.lit(0).cast("bigint").alias("scanned"))
    report = prune_report(df, schema, statement, segment_rows)
    if isinstance(statement.select, Rows):
        report = report.withColumn("group", F.expr(f"segment_id div {GROUP}"))
        earlier = lambda w: F.coalesce(F.sum("matched").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = report.groupBy("group").agg(F.sum("matched").alias("matched"))
        groups = groups.select("group", earlier(Window.orderBy("group")).alias("base"))
        report = report.withColumn("before", earlier(Window.partitionBy("group").orderBy("segment_id"))).join(F.broadcast(groups), "group")
        report = report.where(F.col("base") + F.col("before") < (statement.limit or 1000))
    return report.agg(F.count_if("pruned").alias("pruned"), F.count_if(~F.col("pruned")).alias("scanned"))


def may_match(schema: Schema, predicate: Predicate) -> Column:
    """A condition on ``segment_catalog`` rows that holds wherever a match is possible: bounds decide = IN < > on either side of AND and OR."""
    if not isinstance(predicate, Compare):
        left, right = may_match(schema, predicate.left), may_match(schema, predicate.right)
        return left & right if isinstance(predicate, Both) else left | right
    field, n = schema.find(predicate.column), predicate.column
    values = [v for v in (bind(field.logical, t) for t in predicate.values) if v is not None]
    low, high = (F.col(f"{n}__{e}") if field.logical != "bool" else F.col(f"{n}__{e}").cast("int") for e in ("min", "max"))
    some = F.col(f"{n}__n") > 0
    if not values:
        return F.lit(False)
    if predicate.op in ("=", "in"):
        return some & reduce(Column.__or__, [(literal(v) >= low) & (literal(v) <= high) for v in values])
    v = literal(values[0])
    return some & {"<": low < v, ">": high > v, "!=": ~((low == v) & (high == v))}[predicate.op]
