"""Text lines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import MAX_LINE


def all_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """All lines of the files (``value``); one longer than MAX_LINE bytes is null, so that it is counted and skipped."""
    return _bounded(spark.read.text(list(paths)))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of the files (``value``) of MAX_LINE bytes or less."""
    return all_lines(spark, *paths).where("value is not null")


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """As ``all_lines``, of the files that appear in a folder; ``files_per_trigger`` bounds a micro-batch."""
    return _bounded(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def _bounded(lines: DataFrame) -> DataFrame:
    return lines.select(F.when(F.octet_length("value") <= MAX_LINE, F.col("value")).alias("value"))
