"""What each light-weight encoding would make of a column, segment by segment, and which is least.

Sizes are computed, not encoded: sums over windows of a segment. Nulls take a zero or an empty text,
since encodings hold a place for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bit_width, uvarint_len, zigzag
from ..types import Schema
from .catalog import segment_of
from .store import SEGMENT_ROWS

#: Distinct values that are told apart before an integer column counts as having this many.
DISTINCT_PROBE = 1 << 16
MAX_DICTIONARY = 1 << 24


def _long(df: DataFrame, columns: list[str], value: Column | None, kind: str, segment_rows: int) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast(kind), F.lit(0 if kind == "bigint" else "").cast(kind)).alias("v")) for c in columns))
    return df.select(segment_of(segment_rows), "seq", F.explode(pairs).alias("e")).select("segment_id", "seq", "e.column", "e.v")


def _runs(long: DataFrame, *sums: Column) -> DataFrame:
    """A row per run of equal values, with its length and partial sums."""
    order = Window.partitionBy("segment_id", "column").orderBy("seq")
    before = F.lag("v").over(order)
    d = (F.col("v") - before) if sums else F.lit(None)
    rows = long.withColumn("new", F.coalesce((F.col("v") != before).cast("int"), F.lit(1))).withColumn("d", d)
    rows = rows.withColumn("run", F.sum("new").over(order))
    if sums:
        rows = rows.withColumn("dd", F.col("d") - F.lag("d").over(order))
    return rows.groupBy("segment_id", "column", "run").agg(F.count("*").alias("len"), F.first("v").alias("v"), *sums)


def int_profile(df: DataFrame, columns: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment_id, column, statistics (n, distinct, runs, min, max, sorted), sizes of the integer encodings and the one chosen."""
    long = _long(df, columns, None, "bigint", segment_rows)
    keys = ["segment_id", "column"]
    step = F.sum(F.when(F.col("d").isNotNull(), uvarint_len(zigzag(F.col("d"))))).alias("steps")
    turn = F.sum(F.when(F.col("dd").isNotNull(), uvarint_len(zigzag(F.col("dd")))).when(F.col("d").isNotNull(), uvarint_len(zigzag(F.col("d"))))).alias("turns")
    falls = F.count_if(F.col("d") < 0).alias("falls")
    runs = _runs(long, step, turn, falls)
    # Distinct values of a segment, at most as many as it has rows.
    words = F.array_sort(F.collect_set("v"))
    plain = runs.groupBy(*keys).agg(
        F.sum("len").alias("n"),
        F.count("*").alias("runs"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.sum("falls") == 0).alias("sorted"),
        F.sum(uvarint_len(F.col("v")) * F.col("len")).alias("varint"),
        F.sum(uvarint_len(F.col("v")) + uvarint_len(F.col("len"))).alias("rle"),
        (uvarint_len(F.min_by("v", "run")) + F.coalesce(F.sum("steps"), F.lit(0))).alias("delta"),
        (uvarint_len(F.min_by("v", "run")) + F.coalesce(F.sum("turns"), F.lit(0))).alias("delta2"),
        words.alias("words"),
    )
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("words", F.lit(1), F.size("words") - 1))
    gaps = F.aggregate(F.zip_with("words", before, lambda x, y: uvarint_len(x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    both = plain.withColumn("distinct", F.size("words").cast("bigint")).withColumn("gaps", gaps).drop("words")
    n, width, code = F.col("n"), bit_width(F.col("max") - F.col("min")), bit_width(F.col("distinct") - 1)
    sized = both.select(
        *keys, "n", "distinct", "runs", "min", "max", "sorted",
        (n * 8).alias("plain"), "varint", "rle",
        (uvarint_len(F.col("min")) + 1 + F.ceil(n * width / 8)).cast("bigint").alias("bitpack"),
        "delta", "delta2",
        (uvarint_len(F.col("distinct")) + F.col("gaps") + 1 + F.ceil(n * code / 8)).cast("bigint").alias("dictionary"),
    )
    capped = F.least(F.col("distinct"), F.lit(DISTINCT_PROBE))
    allowed = [("plain", F.lit(True)), ("varint", F.lit(True)), ("rle", F.col("runs") * 3 < n), ("bitpack", F.lit(True)), ("delta", F.lit(True)), ("delta2", F.col("sorted")), ("dictionary", capped * 4 < n * 3)]
    return sized.withColumn("codec", _least(allowed))


def bytes_profile(df: DataFrame, columns: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment_id, column, statistics (n, distinct, runs), sizes of the encodings of byte strings and the one chosen."""
    long = _long(df, columns, None, "string", segment_rows)
    keys = ["segment_id", "column"]
    size = F.octet_length("v")
    framed = uvarint_len(size.cast("bigint")) + size
    runs = _runs(long)
    words = F.collect_set("v")  # at most as many as a segment has rows
    plain = runs.groupBy(*keys).agg(F.sum("len").alias("n"), F.count("*").alias("runs"), F.sum(framed * F.col("len")).alias("raw"), F.sum(framed + uvarint_len(F.col("len"))).alias("rle"), words.alias("words"))
    size_of = lambda w: (uvarint_len(F.octet_length(w).cast("bigint")) + F.octet_length(w)).cast("bigint")
    entries = F.aggregate("words", F.lit(0).cast("bigint"), lambda x, w: x + size_of(w))
    both = plain.withColumn("distinct", F.size("words").cast("bigint")).withColumn("entries", entries).drop("words")
    n = F.col("n")
    sized = both.select(*keys, "n", "distinct", "runs", "raw", "rle", (uvarint_len(F.col("distinct")) + F.col("entries") + 1 + F.ceil(n * bit_width(F.col("distinct") - 1) / 8)).cast("bigint").alias("dictionary"))
    capped = F.least(F.col("distinct"), F.lit(DISTINCT_PROBE + 1))
    return sized.withColumn("codec", _least([("raw", F.lit(True)), ("rle", F.col("runs") * 3 < n), ("dictionary", (capped * 4 < n * 3) & (capped <= MAX_DICTIONARY))]))


def _least(candidates: list[tuple[str, Column]]) -> Column:
    """The first of the smallest allowed sizes, in order."""
    offers = F.filter(F.array(*(F.when(ok, F.struct(F.col(name).cast("bigint").alias("size"), F.lit(i).alias("rank"), F.lit(name).alias("name"))) for i, (name, ok) in enumerate(candidates))), lambda x: x.isNotNull())
    return F.array_min(offers)["name"]


def codec_profile(df: DataFrame, schema: Schema, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment_id, column, n, distinct, runs, size, codec for all columns of a table."""
    ints = [c.name for c in schema.columns if c.logical in ("timestamp", "uint", "port", "bool")]
    texts = [c.name for c in schema.columns if c.logical in ("ip", "enum", "string")]
    parts = []
    if ints:
        p = int_profile(df, ints, segment_rows)
        parts.append((p, ["plain", "varint", "rle", "bitpack", "delta", "delta2", "dictionary"]))
    if texts:
        shown = df.select("seq", *(F.decode(F.col(f"`{c}`"), "ISO-8859-1").alias(c) if schema.find(c).logical == "ip" else F.col(f"`{c}`") for c in texts))
        parts.append((bytes_profile(shown, texts, segment_rows), ["raw", "rle", "dictionary"]))
    out = [p.select("segment_id", "column", "n", "distinct", "runs", F.element_at(F.create_map(*(x for c in sizes for x in (F.lit(c), F.col(c).cast("bigint")))), F.col("codec")).alias("size"), "codec") for p, sizes in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
