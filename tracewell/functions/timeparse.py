"""Timestamps as nanoseconds since 1970: from text and epoch numbers, and to RFC 3339 text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT = r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})?| ([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?)"
#: A pattern for ``rlike`` that the whole text meets; ``$`` would allow a newline after it.
_whole = r"^(?:{})\z".format
_LITERAL = re.compile(_TEXT)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_NANOS = 1_000_000_000


def epoch_to_ns(n: Column) -> Column:
    """Nanoseconds of an epoch number whose unit follows from its size; null on overflow."""
    scaled = lambda unit: F.try_multiply(n, F.lit(unit).cast("bigint"))
    return F.when(n < 10**11, scaled(_NANOS)).when(n < 10**14, scaled(10**6)).when(n < 10**17, scaled(1000)).otherwise(n)


def text_to_ns(text: Column) -> Column:
    """Nanoseconds of RFC 3339 text, or of a date with a time and no zone (taken as UTC); else null.

    One pattern decides; the parts then lie at known places.
    """
    rest = F.substring(text, 20, 64)
    sign = F.substring(rest, -6, 1)
    zone = F.when(rest.endswith("Z"), F.lit("Z")).when((F.length(rest) >= 6) & sign.isin("+", "-"), F.substring(rest, -6, 6)).otherwise(F.lit(""))
    seconds = F.unix_seconds(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.coalesce(F.nullif(zone, F.lit("")), F.lit("Z"))).try_cast("timestamp"))
    digits = F.when(rest.startswith(".") | rest.startswith(","), F.substring(rest, F.lit(2), F.length(rest) - 1 - F.length(zone))).otherwise(F.lit("0"))
    fraction = F.rpad(F.substring(digits, 1, 9), 9, "0").cast("bigint")
    return F.when(text.rlike(_whole(_TEXT)), F.try_add(F.try_multiply(seconds, F.lit(_NANOS).cast("bigint")), fraction))


def parse_time_ns(text: Column) -> Column:
    """Nanoseconds of what log lines hold: text, else a whole or fractional epoch number (its fraction is dropped)."""
    whole = F.when(text.rlike(_whole("[+-]?[0-9]+")), text.try_cast("bigint"))
    number = F.when(text.rlike(_whole(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")), text.try_cast("double"))
    from_number = F.when(F.abs(number) < 9.2e18, number.try_cast("bigint"))
    return F.coalesce(text_to_ns(text), epoch_to_ns(whole), F.when(whole.isNull(), epoch_to_ns(from_number)))


def clf_time_ns(text: Column) -> Column:
    """Nanoseconds of ``02/Jan/2006:15:04:05 -0700``, else null."""
    good = text.rlike(_whole(r"[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}"))
    return F.try_multiply(F.unix_seconds(F.when(good, F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))), F.lit(_NANOS).cast("bigint"))


def format_ns(ns: Column) -> Column:
    """RFC 3339 text in UTC with the fraction's trailing zeros cut."""
    seconds = F.floor(ns / F.lit(_NANOS).cast("decimal(20,0)")).cast("bigint")
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad(F.pmod(ns, F.lit(_NANOS)).cast("string"), 9, "0")), r"\.?0+$", "")
    stamp = F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(F.timestamp_seconds(seconds), "UTC"), "UTC"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(stamp, fraction, F.lit("Z"))


def to_timestamp_us(ns: Column) -> Column:
    """Spark's timestamp, in microseconds, for windows and watermarks."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("bigint"))


def literal_ns(text: str) -> int | None:
    """Nanoseconds of a literal in a statement: the text forms, a date alone, or whole nanoseconds."""
    m = _LITERAL.fullmatch(text)
    if m:
        date, clock, fraction, zone = m[1], m[2] or m[5], m[3] or m[6] or "0", m[4] or "Z"
        try:
            at = datetime.fromisoformat(f"{date}T{clock}").replace(tzinfo=timezone.utc)
        except ValueError:
            return None
        if zone != "Z":
            hours, minutes = int(zone[1:3]), int(zone[4:6])
            if hours > 24 or minutes > 59:
                return None
            at -= timedelta(hours=hours, minutes=minutes) * (1 if zone[0] == "+" else -1)
        return round_seconds(at) * _NANOS + int(fraction[:9].ljust(9, "0"))
    if _DATE.fullmatch(text):
        try:
            return round_seconds(datetime.fromisoformat(text).replace(tzinfo=timezone.utc)) * _NANOS
        except ValueError:
            return None
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    return None


def round_seconds(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
