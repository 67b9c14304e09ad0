"""Shared plumbing of the corpus operators: tables, cluster folders, Arrow text access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; the path may lie in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between Spark and a Python worker: texts may be long, so Spark's 10,000 are too many.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package even if the driver found it by ``sys.path``, and keep their batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) takes the machine's temporary folder; on a
    cluster, whose machines do not share theirs, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}"
    return at


#: Stashes that were made and not discarded.
_made: list[str] = []


def stash(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until ``discard`` or ``sweep``, since plans made on it are evaluated later; what is left
    goes when the driver's process ends.
    """
    spark = df.sparkSession
    if not _made:
        atexit.unregister(_last_sweep)
        atexit.register(_last_sweep)
    path = f"{shared_dir(spark)}/tracewell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a stash that no later plan reads."""
    if path:
        if path in _made:
            _made.remove(path)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, keep: str | None = None, since: int = 0) -> None:
    """Delete the stashes of this driver, from number ``since`` on, but ``keep``; call it once no result that reads them is wanted."""
    for path in _made[since:]:
        if path != keep:
            discard(spark, path)


def stashes() -> int:
    """How many stashes there are, as a mark for ``sweep``."""
    return len(_made)


def _last_sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            sweep(spark)
        except Exception:  # the process ends; a gateway that has gone takes the folder's owner with it
            pass


def wide(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_views(batch: pa.RecordBatch, column: str) -> Iterator[memoryview]:
    """UTF-8 bytes of each text without copying; a null gives empty bytes."""
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(array.type):
        yield from (memoryview(b"") for _ in range(len(array)))
        return
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, ends, data = array.buffers()
    at = np.frombuffer(ends, dtype=np.int64, count=len(array) + 1, offset=8 * array.offset)
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield view[a:b]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches again, none of more than ``rows`` rows, so that a worker's memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``rows`` rows or ``size`` bytes, where a larger one costs less a row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Places of a bitmap of ids for each id, and its places at least and at most (128 MB).
PLACES = 8
LEAST_BITS, MOST_BITS = 16, 30


def bitmap_bits(count: int) -> int:
    """Bits of a place number: the bitmap grows with the ids up to MOST_BITS."""
    return min(MOST_BITS, max(LEAST_BITS, (PLACES * count - 1).bit_length()))


def suspects(rows: DataFrame, id_cols: list[str], ids: DataFrame) -> DataFrame:
    """``rows`` with ``_suspect``: whether the values of ``id_cols`` may be among ``ids`` (as many columns), by a broadcast bitmap.

    The bitmap has PLACES places or more for each id, so that about one row of nine is suspected in
    vain; wide rows that are certainly not named need no shuffle, the suspects are then joined exactly.
    Beyond 134 million ids the bitmap stays at 128 MB and suspects more rows; the result is the same.
    A row with a null among its values is no suspect.
    """
    bits = bitmap_bits(ids.count())
    place = lambda names: F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in names)), F.lit(1 << bits)) + 1
    maps = ids.select(place(ids.columns).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(place(id_cols))).withColumn("_bit", F.bitmap_bit_position(place(id_cols)))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit: Column = F.floor(byte / F.pow(F.lit(2.0), F.col("_bit") % 8)) % 2 == 1
    known = [F.col(f"`{c}`").isNotNull() for c in id_cols]
    return placed.join(F.broadcast(maps), "_bucket", "left").select(*(F.col(f"`{c}`") for c in rows.columns), (F.coalesce(hit, F.lit(False)) & reduce(Column.__and__, known)).alias("_suspect"))
