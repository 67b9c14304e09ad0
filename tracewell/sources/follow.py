"""A streaming source that follows files as they grow.

Spark's file source takes a file once; lines appended later are never seen. This source keeps a
byte offset per file in the query's checkpoint and hands out whole lines that were added since,
so a restarted query goes on where it stopped. The driver reads the files, so it follows a handful of
logs on its own machine; many files, or files elsewhere, come as a folder stream (``stream_lines``).
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..types import MAX_LINE

#: Bytes of one file that a micro-batch reads, at most (and MAX_LINE more where no line ends in them).
BATCH_BYTES = 32 << 20


class FollowSource(DataSource):
    """Format ``tracewell_follow``; option ``path`` (a file or pattern), ``from`` (start or end)."""

    @classmethod
    def name(cls) -> str:
        return "tracewell_follow"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Follower(self.options["path"], self.options.get("from", "start"))


class _Follower(SimpleDataSourceStreamReader):
    def __init__(self, pattern: str, begin: str):
        self.pattern, self.begin = pattern, begin

    def _files(self) -> list[str]:
        return sorted(glob.glob(self.pattern)) if glob.has_magic(self.pattern) else [p for p in [self.pattern] if os.path.exists(p)]

    def initialOffset(self) -> dict:
        return {p: os.path.getsize(p) for p in self._files()} if self.begin == "end" else {}

    def read(self, start: dict):
        end, out = dict(start), []
        for path in self._files():
            lines, end[path] = _added(path, start.get(path, 0), None)
            out += lines
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([line for path, to in sorted(end.items()) for line in _added(path, start.get(path, 0), to)[0]])

    def commit(self, end: dict) -> None:
        pass


def _added(path: str, start: int, stop: int | None) -> tuple[list[tuple[str | None]], int]:
    """Whole lines from ``start`` on, and where they end.

    A line longer than MAX_LINE gives one null, so that it is counted and skipped. If its end is not yet
    there, the place inside it comes back as a negative number, and the rest of the line is passed over later.
    """
    size, inside = os.path.getsize(path), start < 0
    start = abs(start)
    if size < start:  # the file was cut: begin anew
        start, inside = 0, False
    to = min(abs(stop), size) if stop is not None else min(size, start + BATCH_BYTES)
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(to - start)
        if stop is None and data and b"\n" not in data:
            data += f.readline(MAX_LINE)
    lines: list[tuple[str | None]] = []
    if inside:
        end = data.find(b"\n") + 1
        if not end:
            return [], -(start + len(data)) if data else -start
        start, data = start + end, data[end:]
    cut = data.rfind(b"\n") + 1
    lines += [(line.decode("utf-8", "replace") if len(line) <= MAX_LINE else None,) for line in data[:cut].split(b"\n")[:-1]]
    if len(data) - cut > MAX_LINE:
        return [*lines, (None,)], -(start + len(data))
    return lines, start + cut


def follow(spark: SparkSession, path: str, from_end: bool = False):
    """Lines of a growing file as a stream (``value``). The path must be open to the driver."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("tracewell_follow").option("path", path).option("from", "end" if from_end else "start").load()
