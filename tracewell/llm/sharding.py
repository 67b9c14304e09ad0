"""Sharding by a keyed permutation of global row numbers, in DataFrame operations only.

Every row gets a gapless global number; a Feistel network over a square domain just above the
row count permutes it, walking the cycle back into range where it leaves it. The permuted
position ``p`` gives shard ``p mod n`` and slot ``p div n``: shard sizes differ by one row at
most, slots are gapless, and the place of any row is computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import stash, wide

ROUNDS = 6
#: Steps of the cycle walk that are laid out as columns; the rare rest goes on in one expression.
WALK = 3
#: A row that stands for more equal rows than this is unfolded in blocks of this many.
BLOCK = 65_536


def _round(half: Column, number: Column | int, seed: int, side: int) -> Column:
    number = number if isinstance(number, Column) else F.lit(number)
    return F.pmod(F.xxhash64(half, number.cast("int"), F.lit(seed)), F.lit(side).cast("long"))


def _network(x: Column, side: int, seed: int) -> Column:
    """All rounds in one expression, for the rare rows that walk on."""
    start = F.struct((x / side).cast("long").alias("l"), F.pmod(x, F.lit(side)).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _round(s["r"], i, seed, side), F.lit(side)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * side + s["r"])


def permute(df: DataFrame, number: str, total: int, seed: int, out: str) -> DataFrame:
    """Add ``out``: the place of ``number`` (0 to ``total`` - 1) under the keyed permutation."""
    side = max(1, math.isqrt(max(total, 1) - 1) + 1)
    excess = side * side - total
    kept = df.columns
    df = df.withColumn("_p", F.col(number).cast("long"))
    for walk in range(WALK if excess else 1):
        moved = df.select("*", F.expr(f"_p div {side}").alias("_l"), F.pmod("_p", F.lit(side).cast("long")).alias("_r"))
        for i in range(ROUNDS):
            moved = moved.select(*kept, "_p", F.col("_r").alias("_l"), F.pmod(F.col("_l") + _round(F.col("_r"), i, seed, side), F.lit(side).cast("long")).alias("_r"))
        value = F.col("_l") * side + F.col("_r")
        df = moved.select(*kept, (F.when(F.col("_p") < total, F.col("_p")).otherwise(value) if walk else value).alias("_p"))
    if excess:
        # Cycle walking ends after at most ``excess`` steps; hardly a row gets here.
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(excess)), F.col("_p"), lambda p, _: F.when(p < total, p).otherwise(_network(p, side, seed)))
        df = df.select(*kept, F.when(F.col("_p") < total, F.col("_p")).otherwise(rest).alias("_p"))
    return df.select(*kept, F.col("_p").alias(out))


def shard_plan(docs: DataFrame, shards: int = 24, seed: int = 20_24, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Global numbers follow (bucket, id, size, checksum), where the bucket is a hash of these
    three, so they depend on the rows alone, not on files or partitions. ``buckets`` bounds the
    table of offsets that is broadcast. Equal rows (same id and text) are counted before the
    shuffle and interchangeable, so a third of all rows being equal puts no load on one task.
    Cases: a null id is an id of its own; a null text has size 8 and checksum 0, as an empty one;
    an empty table gives no rows; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows, _ = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-values")  # texts are read once
    first, total, largest = _numbered(rows, buckets)
    values = ("doc_id", "size", "text_crc32")
    spread = first.select(*values, "first", "n")
    if largest > BLOCK:
        # A row may stand for very many equal ones: unfold those in blocks and deal the blocks out in between.
        block = F.expr(f"transform(sequence(0L, (n - 1) div {BLOCK}), b -> named_struct('first', first + b * {BLOCK}, 'n', least(n - b * {BLOCK}, {BLOCK}L)))")
        blocks = spread.where(f"n > {BLOCK}").select(*values, F.explode(block).alias("b")).select(*values, "b.first", "b.n")
        spread = spread.where(f"n <= {BLOCK}").unionByName(blocks.repartition("doc_id", "first"))
    numbered = spread.select(*values, F.explode(F.expr("sequence(first, first + n - 1)")).alias("row"))
    return _placed(numbered, total, shards, seed).select(*values, "shard", "slot")


def _placed(numbered: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """Shard and slot of the global number ``row``."""
    placed = permute(numbered, "row", total, seed, "place")
    return placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def _numbered(rows: DataFrame, buckets: int) -> tuple[DataFrame, int, int]:
    """Distinct (doc_id, size, text_crc32) with their count ``n`` and first global number; rows in all; rows of the largest bucket."""
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket")
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n")).collect()  # at most ``buckets`` rows
    starts, total = [], 0
    for bucket_no, n in sorted((r["bucket"], r["n"]) for r in sizes):
        starts.append((bucket_no, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "bucket int, start long")
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).select(bucket, "*")
    order = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = distinct.withColumn("first", before).join(F.broadcast(offsets), "bucket").withColumn("first", F.col("first") + F.col("start"))
    return first, total, max((r["n"] for r in sizes), default=0)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 20_24, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as one folder per shard, in files that hold ranges of slots in order.

    Places are those of ``shard_plan``. Rows are placed one by one, not by id: rows that are equal in
    id and text take the places of their group in scan order, so each is written just once.
    ``files`` is the number of files in all (as many as the session has shuffle partitions). Cases: a
    null id is an id of its own; null texts stay null; repeated rows stay; an empty table writes no
    folder; columns named shard or slot are replaced, the others stay.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    # Written once, so that partitions are what they were when the places are joined.
    rows, _ = stash(docs.select(F.struct(*kept).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    values = ["doc_id", "size", "text_crc32"]
    first, total, _ = _numbered(rows.select(*values), 4096)
    # Equal rows are numbered within blocks of the scan, and the blocks after each other: no task holds a whole group.
    block = F.shiftright("at", 33).alias("block")
    parts = rows.groupBy(*values, block).agg(F.count("*").alias("m"))
    ahead = F.sum("m").over(Window.partitionBy(*values).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    parts = parts.withColumn("ahead", ahead).drop("m")
    mine = rows.withColumn("block", F.shiftright("at", 33)).withColumn("k", F.row_number().over(Window.partitionBy(*values, "block").orderBy("at")) - 1)

    def same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        other = b.withColumnsRenamed({n: f"_{n}" for n in names})
        return a.join(other, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]).drop(*(f"_{n}" for n in names))

    numbered = same(same(mine, parts, [*values, "block"]), first.select(*values, "first"), values)
    placed = _placed(numbered.withColumn("row", F.col("first") + F.col("ahead") + F.col("k")), total, shards, seed)
    out = placed.repartitionByRange(files or wide(spark), "shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("doc.*", "shard", "slot").write.partitionBy("shard").parquet(path)
