"""Tables on disk: Parquet with zstd, delta encodings, row-group statistics and Bloom filters on indexed columns.

Opt-in indexes (histograms and postings of indexed columns) lie beside the data in ``_index``, which
readers of the data pass over.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ast import Count, Top
from ..plans.compiler import check, compile
from ..plans.parser import parse
from ..types import Column, Schema, StorageError

#: Rows of a segment, the unit that pruning is reported in.
SEGMENT_ROWS = 65_536


@dataclass(frozen=True)
class WriteOptions:
    compression: str = "zstd"  # zstd, lz4 or uncompressed
    zstd_level: int = 3
    segment_rows: int | None = None  # rows of a row group, at most; None: by bytes alone, which scans best at size
    bloom: bool = True
    distinct: Mapping[str, int] | None = None  # expected distinct values by column, for the filters' size
    block_bytes: int = 128 << 20
    index: bool = False  # build histograms and postings of indexed columns

    def parquet(self, schema: Schema) -> dict[str, str]:
        out = {"compression": self.compression, "parquet.writer.version": "PARQUET_2_0", "parquet.compression.codec.zstd.level": str(self.zstd_level), "parquet.block.size": str(self.block_bytes), "parquet.page.write-checksum.enabled": "true"}
        if self.compression == "uncompressed":
            # Spark's vectorized reader gives wrong bytes for delta-coded binary pages that aren't compressed.
            out["parquet.writer.version"] = "PARQUET_1_0"
        if self.segment_rows:
            out["parquet.block.row.count.limit"] = str(self.segment_rows)
            # A writer holds the filters of all row groups until it closes the file, each with its candidates from
            # the most bytes down to a sixteenth: so no more bytes than the values of a full group need.
            out["parquet.bloom.filter.max.bytes"] = str(min(1 << 20, 1 << (10 * self.segment_rows // 8).bit_length()))
        # Filters sized by what a file holds; else each would take a megabyte.
        out |= {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.fpp": "0.01"}
        for c in schema.columns:
            if c.logical == "timestamp" or not c.indexed and c.logical in ("uint", "port"):
                out[f"parquet.enable.dictionary#{c.name}"] = "false"  # wide ranges pack better as deltas
            if c.indexed and self.bloom:
                out[f"parquet.bloom.filter.enabled#{c.name}"] = "true"
                if n := (self.distinct or {}).get(c.name):
                    out[f"parquet.bloom.filter.expected.ndv#{c.name}"] = str(n)
        return out


def number_rows(df: DataFrame, name: str = "seq") -> DataFrame:
    """Gapless numbers in scan order: rows count up within a partition after all earlier partitions.

    One pass counts the partitions, a second numbers; no shuffle. A row for each partition reaches the
    driver and comes back as a broadcast table of 16 bytes a partition. The input must scan alike twice,
    as files do.
    """
    place = F.monotonically_increasing_id()
    sizes = sorted((r["p"], r["n"]) for r in df.select(F.shiftright(place, 33).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    placed = df.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(offsets), "_part", "left")
    return placed.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_start")


def write_table(df: DataFrame, path: str, schema: Schema, options: WriteOptions | None = None, mode: str = "errorifexists") -> None:
    """Write records, in ``seq`` order within files where they have it, and their indexes if asked for."""
    options = options or WriteOptions()
    rows = df.sortWithinPartitions("seq") if "seq" in df.columns else df
    kept = [F.col(f"`{c.name}`").alias(c.name, metadata=schema.metadata(c)) for c in schema.columns]
    rows.select(*(["seq"] if "seq" in df.columns else []), *kept).write.mode(mode).options(**options.parquet(schema)).parquet(path)
    if options.index:
        build_index(df.sparkSession, path, options.segment_rows or SEGMENT_ROWS)


def read_table(spark: SparkSession, *paths: str, recover: bool = False) -> tuple[DataFrame, Schema]:
    """A written table and its schema, from the metadata that Parquet keeps with each field; pages are held against their checksums.

    ``recover`` passes over files that were cut off or damaged and reads all others, as after a crash of
    a writer other than this one, which commits its files whole.
    """
    try:
        df = spark.read.option("parquet.page.verify-checksum.enabled", "true").option("ignoreCorruptFiles", str(recover).lower()).parquet(*paths)
    except AnalysisException as e:
        raise StorageError(f"no table at {', '.join(paths)}: {e.getCondition()}") from e
    whole = Schema.from_struct(df.schema)
    return df, replace(whole, columns=tuple(c for c in whole.columns if c.name != "seq"))


def build_index(spark: SparkSession, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Write the histogram and the postings of each indexed column of a table with ``seq``, from the table as it is."""
    from .indexes import histogram, postings

    df, schema = read_table(spark, path)
    if "seq" not in df.columns:
        raise StorageError(f"the table at {path} has no seq, which indexes refer to")
    for c in schema.columns:
        if c.indexed:
            histogram(df, c.name, segment_rows).write.mode("overwrite").parquet(f"{path}/_index/histogram/{c.name}")
            postings(df, c.name, segment_rows).write.mode("overwrite").parquet(f"{path}/_index/postings/{c.name}")


def read_index(spark: SparkSession, path: str, kind: str, column: str) -> DataFrame | None:
    """The ``histogram`` or ``postings`` of a column, None if it was not built."""
    try:
        return spark.read.parquet(f"{path}/_index/{kind}/{column}")
    except AnalysisException:
        return None


def query_table(spark: SparkSession, path: str, text: str, recover: bool = False) -> DataFrame:
    """The typed result of a statement on a stored table.

    Without a condition, count(*) comes from the footers alone and top from the stored histogram,
    if there is one; all else is compiled over the data.
    """
    from .indexes import histogram_top

    df, schema = read_table(spark, path, recover=recover)
    statement = check(schema, parse(text))
    if recover:
        return compile(df, schema, statement)
    if statement.where is None and isinstance(statement.select, Count):
        return footer_stats(spark, path).select(F.col("rows").alias("count"))
    if statement.where is None and isinstance(statement.select, Top):
        found = read_index(spark, path, "histogram", statement.select.column)
        if found is not None:
            return histogram_top(found, schema, statement.select.column, statement.select.n)
    return compile(df, schema, statement)


def footer_stats(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """rows, and min and max of the columns, from Parquet footers alone.

    The aggregate is pushed into the scan, which the second-generation reader does; it is switched on
    in a session of its own, so the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    bounds = [b for c in columns for b in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return own.read.parquet(path).agg(F.count("*").alias("rows"), *bounds)


def describe(schema: Schema) -> str:
    """A schema as JSON text."""
    return json.dumps({"id": schema.id, "name": schema.name, "version": schema.version, "columns": [vars(c) for c in schema.columns]}, indent=1)


def parse_schema(text: str) -> Schema:
    raw = json.loads(text)
    return Schema(raw["name"], tuple(Column(**c) for c in raw["columns"]), raw["id"], raw["version"]).check()
