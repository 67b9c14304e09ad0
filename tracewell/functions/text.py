"""Text and number helpers of the line formats and of the codec size model."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r'"([^"]*)"?|\[([^\]]*)\]?|([^ "\[][^ ]*)'


def ascii_upper(text: Column) -> Column:
    """Upper case of a-z alone (``upper`` would turn other letters too)."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def trim_blank(text: Column) -> Column:
    """Without spaces, tabs, carriage returns and newlines at the ends."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def split_clf(line: Column) -> Column:
    """Tokens of a web log line: runs without spaces, ``"quoted"`` or ``[bracketed]``, delimiters off."""
    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))
    strip = lambda t: F.when(t.startswith('"'), F.regexp_replace(F.substring(t, 2, 1 << 22), '"$', "")).when(t.startswith("["), F.regexp_replace(F.substring(t, 2, 1 << 22), r"\]$", "")).otherwise(t)
    return F.transform(tokens, strip)


def zigzag(n: Column) -> Column:
    """Signed numbers folded so that small ones of either sign stay small."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1).cast("bigint"))))


def uvarint_len(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits; a negative one counts as 2^64 more."""
    long = F.when(n < 0, F.lit(10))
    for j in range(8, 0, -1):
        long = long.when(n >= (1 << (7 * j)), F.lit(j + 1))
    return long.otherwise(F.lit(1))


def bit_width(n: Column) -> Column:
    """Bits that hold a number; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n)))


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError
