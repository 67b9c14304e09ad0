"""Command line: ``python -m tracewell.cli COMMAND``.

pack, info, search, query, ingest, gen, bench and version.
"""

from __future__ import annotations

import argparse
import signal
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .functions.text import human_bytes
from .functions.timeparse import format_ns
from .operators import catalog, store
from .plans.compiler import format_result, search
from .sources import adapters, datagen
from .sources.follow import follow
from .sources.lines import stream_lines
from .sources.spool import Spool
from .streaming.ingest import ingest, pack, stats
from .types import Schema, StorageError, TracewellError

VERSION = "0.1.0"
TABLE_FORMAT = "parquet-v2"


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def show(result: DataFrame, schema: Schema, out=None) -> None:
    """Rows as text with tabs between cells, under a line of names. Results are bounded by their limit."""
    text = format_result(result, schema)
    print("\t".join(text.columns), file=out or sys.stdout)
    for row in text.toLocalIterator():
        print("\t".join(row), file=out or sys.stdout)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pack", help="decode files into a table")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-s", "--source", required=True, choices=adapters.names())
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--compression", default="zstd", choices=("zstd", "lz4", "uncompressed"))
    p.add_argument("--level", type=int, default=3)
    p.add_argument("--segment-rows", type=int, default=None, help="rows of a row group, at most")
    p.add_argument("--index", action="store_true", help="build histograms and postings of indexed columns")
    p.add_argument("--wide", action="store_true", help="keep unsigned numbers from 2^63 on")
    p = sub.add_parser("info", help="what a table holds")
    p.add_argument("table")
    p.add_argument("--recover", action="store_true", help="pass over files that are damaged or cut off")
    p = sub.add_parser("search", help="rows whose field has a value; ip and port stand for all such columns")
    p.add_argument("field")
    p.add_argument("value")
    p.add_argument("table")
    p.add_argument("--limit", type=int, default=100)
    p = sub.add_parser("query", help="run a statement")
    p.add_argument("sql")
    p.add_argument("table")
    p.add_argument("--recover", action="store_true", help="pass over files that are damaged or cut off")
    p = sub.add_parser("ingest", help="stream a folder, a growing file, or standard input (-) into a table")
    p.add_argument("input")
    p.add_argument("-s", "--source", required=True, choices=adapters.names())
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--interval", type=float, default=5.0)
    p.add_argument("--follow", action="store_true", help="the input is a file that grows")
    p.add_argument("--once", action="store_true", help="take what is there and end")
    p.add_argument("--wide", action="store_true", help="keep unsigned numbers from 2^63 on")
    p = sub.add_parser("gen", help="write synthetic lines")
    p.add_argument("source", choices=datagen.SOURCES)
    p.add_argument("-n", "--rows", type=int, default=100_000)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("-o", "--out", required=True)
    p = sub.add_parser("bench", help="compression ratio and decode rate on synthetic lines")
    p.add_argument("-n", "--rows", type=int, default=200_000)
    p.add_argument("-o", "--out", required=True)
    sub.add_parser("version")
    a = parser.parse_args(argv)
    try:
        return _run(a)
    except TracewellError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    if a.command == "version":
        print(f"tracewell {VERSION}, tables {TABLE_FORMAT}")
        return 0
    spark = _session()
    if a.command == "pack":
        done = pack(spark, a.source, a.inputs, a.out, store.WriteOptions(a.compression, a.level, a.segment_rows, index=a.index), a.wide)
        size, written = sum(_bytes(spark, i) for i in a.inputs), _bytes(spark, a.out)
        print(f"{done.records} records, {done.skipped} skipped, {human_bytes(size)} -> {human_bytes(written)} ({size / max(written, 1):.1f}x)")
    elif a.command == "gen":
        datagen.generate(spark, a.source, a.rows, a.seed).write.text(a.out)
    elif a.command == "ingest":
        spool = Spool(spark, sys.stdin.buffer, f"{a.checkpoint}-spool") if a.input == "-" else None
        lines = stream_lines(spark, spool.folder) if spool else follow(spark, a.input) if a.follow else stream_lines(spark, a.input)
        if spool:
            spool.start()
            if a.once:
                spool.join()
        running = ingest(lines, a.source, a.out, a.checkpoint, None if a.once else f"{a.interval} seconds", wide=a.wide)
        # SIGTERM ends it like Ctrl-C: what has come in is committed first.
        before = signal.signal(signal.SIGTERM, signal.default_int_handler)
        try:
            while running.isActive and (a.once or not spool or spool.is_alive()):
                time.sleep(0.2)  # here, and in no call of the gateway, a signal lands
            if running.isActive:  # standard input has ended
                running.processAllAvailable()
                running.stop()
            running.awaitTermination()
        except KeyboardInterrupt:
            running.processAllAvailable()
            running.stop()
        finally:
            signal.signal(signal.SIGTERM, before)
        if spool and spool.error:
            raise StorageError(f"standard input could not be spooled: {spool.error}")
        done = stats(running)
        print(f"{done.lines} lines, {done.records} records, {done.skipped} skipped")
    elif a.command == "bench":
        for source in datagen.SOURCES:
            text, table = f"{a.out}/{source}-lines", f"{a.out}/{source}-table"
            datagen.generate(spark, source, a.rows).write.mode("overwrite").text(text)
            began = time.time()
            done = pack(spark, source, [text], table, store.WriteOptions())
            took, size, written = time.time() - began, _bytes(spark, text), _bytes(spark, table)
            print(f"{source}: {done.records} records, {human_bytes(size)}, {size / written:.1f}x, {size / took / 1e6:.0f} MB/s")
    else:
        df, schema = store.read_table(spark, a.table, recover=getattr(a, "recover", False))
        if a.command == "info":
            facts = catalog.info(df, schema)
            from pyspark.sql import functions as F

            span = spark.createDataFrame([(facts["min_ts"], facts["max_ts"])], "a long, b long").select(format_ns(F.col("a")), format_ns(F.col("b"))).first()
            print(f"{facts['schema']}: {facts['rows']} rows, {facts['columns']} columns, {facts['segments']} segments, {human_bytes(_bytes(spark, a.table))}, {span[0]} to {span[1]}")
            for c in schema.columns:
                print(f"  {c.name}\t{c.logical}{' indexed' if c.indexed else ''}{' nullable' if c.nullable else ''}")
        elif a.command == "search":
            show(search(df, schema, a.field, a.value, a.limit), schema)
        else:
            show(store.query_table(spark, a.table, a.sql, a.recover), schema)
    return 0


if __name__ == "__main__":
    sys.exit(main())
