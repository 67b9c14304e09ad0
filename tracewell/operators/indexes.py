"""Optional index tables: postings as bitmaps, and histograms that answer top() without the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import shown
from ..types import Schema
from .catalog import segment_of
from .store import SEGMENT_ROWS

#: Distinct values of a column in a segment beyond which no postings are kept.
MAX_VALUES = 65_536
#: 64-bit words of a bitmap, and the positions it has.
WORDS = 4
PAGE = 64 * WORDS


def postings(df: DataFrame, column: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment_id, value, bucket, bits: the row positions of each value in each segment.

    Positions start at 1 within bitmaps of PAGE, whose bytes and bits are in the order of Spark's bitmap
    functions. Their own aggregates hold and shuffle 4 KB for each value, however rare; these take
    PAGE / 8 bytes in hash tables of fixed width. Segments with more than MAX_VALUES values are left out.
    """
    position = f"pmod(seq, {segment_rows})"
    rows = df.where(F.col(f"`{column}`").isNotNull()).select(segment_of(segment_rows), F.col(f"`{column}`").alias("value"), F.expr(f"{position} div {PAGE} + 1").alias("bucket"), F.expr(f"{position} % {PAGE}").alias("bit"))
    place = F.expr("shiftleft(1L, cast(8 * (7 - bit % 64 div 8) + bit % 8 as int))")
    words = (F.bit_or(F.when(F.expr(f"bit div 64 = {i}"), place)).alias(f"w{i}") for i in range(WORDS))
    built = rows.groupBy("segment_id", "value", "bucket").agg(*words).select("segment_id", "value", "bucket", _bits().alias("bits"))
    if segment_rows <= MAX_VALUES:
        return built
    few = built.groupBy("segment_id").agg(F.count_distinct("value").alias("n")).where(f"n <= {MAX_VALUES}").select("segment_id")
    return built.join(few, "segment_id", "left_semi")


def _bits() -> Column:
    """The bitmap of the words w0 to w3, the first byte of a word being its highest."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.coalesce(f"w{i}", F.lit(0).cast("bigint"))), 16, "0") for i in range(WORDS))))


def _words() -> list[Column]:
    """The words w0 to w3 of ``bits``."""
    half = lambda at: F.conv(F.hex(F.substring("bits", at, 4)), 16, 10).cast("bigint")
    return [F.shiftleft(half(8 * i + 1), 32).bitwiseOR(half(8 * i + 5)).alias(f"w{i}") for i in range(WORDS)]


def posting_counts(index: DataFrame) -> DataFrame:
    """segment_id, value, count from postings alone."""
    return index.groupBy("segment_id", "value").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("count"))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """segment_id, bucket, bits of the rows that two selections of postings share."""
    sides = _merged(left).unionByName(_merged(right))
    shared = sides.groupBy("segment_id", "bucket").agg(F.count("*").alias("n"), *(F.bit_and(f"w{i}").alias(f"w{i}") for i in range(WORDS))).where("n = 2")
    return shared.select("segment_id", "bucket", _bits().alias("bits"))


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """segment_id, bucket, bits of the rows that at least one selection of postings has."""
    return _merged(left.select("segment_id", "bucket", "bits").unionByName(right.select("segment_id", "bucket", "bits"))).select("segment_id", "bucket", _bits().alias("bits"))


def _merged(index: DataFrame) -> DataFrame:
    """segment_id, bucket and the words of all its bitmaps together."""
    return index.select("segment_id", "bucket", *_words()).groupBy("segment_id", "bucket").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def matched_rows(selection: DataFrame) -> DataFrame:
    """``count`` of the rows in a selection."""
    return selection.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("count"))


def histogram(df: DataFrame, column: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment_id, value, count of the non-null values."""
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(segment_of(segment_rows), F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count"))


def histogram_top(table: DataFrame, schema: Schema, column: str, n: int = 10) -> DataFrame:
    """top(column, n) from a histogram."""
    counts = table.groupBy(F.col("value").alias(column)).agg(F.sum("count").cast("bigint").alias("count"))
    return counts.orderBy(F.desc("count"), shown(schema.find(column).logical, F.col(f"`{column}`"))).limit(n)
