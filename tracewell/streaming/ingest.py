"""Lines in, typed tables out: batch ``pack`` and streaming ``ingest``."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.store import WriteOptions, number_rows, write_table
from ..sources import adapters
from ..sources.lines import all_lines


@dataclass(frozen=True)
class Stats:
    lines: int
    records: int
    skipped: int


def _counts() -> list:
    return [F.count(F.lit(1)).alias("lines"), F.count("record").alias("records")]


def pack(spark: SparkSession, source: str, paths: list[str], out: str, options: WriteOptions | None = None, wide: bool = False) -> Stats:
    """Decode files and write one table; lines that do not decode, or are too long, are counted and left out.

    ``seq`` is the number of the line in the input, counted from 0: gapless but for skipped lines. One
    cheap pass counts the lines of each split, a second decodes and writes.
    """
    seen = Observation("pack")
    decoded = adapters.decode_lines(number_rows(all_lines(spark, *paths)), source, wide=wide).observe(seen, *_counts())
    schema = adapters.get(source, wide).schema
    write_table(decoded.where("record is not null").select("record.*", "seq"), out, schema, options)
    got = seen.get
    return Stats(got["lines"], got["records"], got["lines"] - got["records"])


def pack_numbered(lines: DataFrame, source: str, out: str, options: WriteOptions | None = None) -> None:
    """As ``pack``, but ``seq`` counts the records alone, for segment-exact reports; lines are decoded twice."""
    write_table(number_rows(adapters.records(lines, source)), out, adapters.get(source).schema, options)


def ingest(lines: DataFrame, source: str, out: str, checkpoint: str, every: str | None = "5 seconds", options: WriteOptions | None = None, wide: bool = False) -> StreamingQuery:
    """Start a stream of lines into a table.

    Each micro-batch is committed whole, and a restart with the same checkpoint goes on after the
    last commit, so nothing is lost or repeated. ``seq`` rises from batch to batch and within the
    partitions of one. ``every`` is the interval of commits; None takes all that is there and ends.
    Counters are in ``stats(query)``.
    """
    _Totals.of(lines.sparkSession)
    decoded = adapters.decode_lines(lines, source, wide=wide, numbered=True).observe("ingest", *_counts())
    schema = adapters.get(source, wide).schema
    rows = decoded.where("record is not null").select("seq", "record.*")
    kept = rows.select("seq", *(F.col(f"`{c.name}`").alias(c.name, metadata=schema.metadata(c)) for c in schema.columns))
    writer = kept.writeStream.format("parquet").outputMode("append").options(**(options or WriteOptions()).parquet(schema)).option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class _Totals(StreamingQueryListener):
    """Counters of every run, added up as its batches end: a query itself remembers the last hundred only."""

    found: dict[int, _Totals] = {}

    def __init__(self):
        self.runs: dict[str, list[int]] = {}
        self.last: dict[str, int] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> _Totals:
        key = id(spark)
        if key not in cls.found:
            cls.found[key] = cls()
            spark.streams.addListener(cls.found[key])
        return cls.found[key]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        if event.progress.batchId <= self.last.get(run, -1):
            return  # a trigger without data repeats the number of the batch before
        seen = event.progress.observedMetrics.get("ingest")
        total = self.runs.setdefault(run, [0, 0])
        if seen is not None:
            self.last[run] = event.progress.batchId
            total[0] += seen["lines"]
            total[1] += seen["records"]

    def onQueryTerminated(self, event) -> None:
        pass


def stats(query: StreamingQuery, patience: float = 10.0) -> Stats:
    """Counters of a run over all its micro-batches so far; waits up to ``patience`` seconds for the last one's."""
    totals, run, until = _Totals.of(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()), str(query.runId), time.time() + patience
    wanted = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)
    while totals.last.get(run, -1) < wanted and time.time() < until:
        time.sleep(0.05)
    lines, records = totals.runs.get(run, (0, 0))
    return Stats(lines, records, lines - records)
