"""Log lines to typed columns, an Arrow batch at a time.

The rules of the line formats (first usable alias, numbers in text, two ways to write a time) need a
branch for every value: as Catalyst expressions they make a plan of hundreds of kilobytes, which takes
longer to compile than the lines to read. Here a line is parsed once, strictly, and each field taken
from the parsed object. The module uses nothing of its package, since it travels to the workers by value.
"""

from __future__ import annotations

import ipaddress
import json
import re
import socket
import string
from collections.abc import Callable, Iterator
from datetime import date
from decimal import Decimal

import pyarrow as pa

_MAPPED = bytes(10) + b"\xff\xff"
_BLANK = " \t\r\n"
_UPPER = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
_EPOCH = date(1970, 1, 1).toordinal()
_TIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(T| )([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})?")
_WHOLE = re.compile(r"[+-]?[0-9]+")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
_CLF_TIME = re.compile(r"([0-9]{2})/([A-Za-z]{3})/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-])([0-9]{2})([0-9]{2})")
_CLF_TOKEN = re.compile(r'"([^"]*)"?|\[([^\]]*)\]?|([^ "\[][^ ]*)')
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Parsed values that a worker remembers of each kind, at most.
REMEMBERED = 100_000
LONG = 1 << 63


class _Cache(dict):
    """Results of a function of one text; starts anew when full."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, text):
        value = self.of(text)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(text) <= 64:
            self[text] = value
        return value


def address(text: str) -> bytes | None:
    """16 bytes of an IPv4 (mapped) or IPv6 address, else None; a zone is dropped, but not allowed after a mapped address."""
    try:
        return _MAPPED + socket.inet_pton(socket.AF_INET, text)
    except (OSError, ValueError):
        pass
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return None if found.scope_id is not None and found.packed.startswith(_MAPPED) else found.packed


def _day(text: str) -> int | None:
    """Seconds at the start of YYYY-MM-DD."""
    try:
        return (date(int(text[:4]), int(text[5:7]), int(text[8:10])).toordinal() - _EPOCH) * 86_400
    except ValueError:
        return None


_days = _Cache(_day)


def epoch_ns(n: int) -> int | None:
    """Nanoseconds of an epoch number whose unit follows from its size; None beyond 64 bits."""
    ns = n * 1_000_000_000 if n < 10**11 else n * 1_000_000 if n < 10**14 else n * 1000 if n < 10**17 else n
    return ns if -LONG <= ns < LONG else None


def time_ns(text: str) -> int | None:
    """Nanoseconds of RFC 3339 text, of a date and time without a zone (UTC), or of an epoch number."""
    m = _TIME.fullmatch(text)
    if m and not (m[4] == " " and m[9]):
        day, hour, minute, second = _days[text[:10]], int(m[5]), int(m[6]), int(m[7])
        if day is not None and hour < 24 and minute < 60 and second < 60:
            at = day + hour * 3600 + minute * 60 + second
            if (zone := m[9]) and zone != "Z":
                hours, minutes = int(zone[1:3]), int(zone[4:6])
                if hours > 24 or minutes > 59:
                    return None
                at -= (hours * 3600 + minutes * 60) * (1 if zone[0] == "+" else -1)
            ns = at * 1_000_000_000 + (int(m[8][:9].ljust(9, "0")) if m[8] else 0)
            return ns if -LONG <= ns < LONG else None
        return None
    if _WHOLE.fullmatch(text):
        if len(text) <= 40 and -LONG <= (n := int(text)) < LONG:
            return epoch_ns(n)
    if _NUMBER.fullmatch(text):
        f = float(text)
        return epoch_ns(int(f)) if abs(f) < 9.2e18 else None
    return None


def scalar_text(value) -> str | None:
    """Text of a JSON string, number or boolean; None of anything else."""
    kind = type(value)
    if kind is str:
        return value
    if kind is bool:
        return "true" if value else "false"
    if kind is int:
        return str(value)
    if kind is float:
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return None


def first_text(record: dict, keys: tuple[str, ...]) -> str | None:
    """Text of the first key that holds a string, number or boolean."""
    for key in keys:
        value = record.get(key)
        if value is not None and (text := value if type(value) is str else scalar_text(value)) is not None:
            return text
    return None


def first_uint(record: dict, keys: tuple[str, ...]) -> int | None:
    """The first key that holds a number (its fraction dropped) or digits; a negative number ends the search with None."""
    for key in keys:
        value = record.get(key)
        kind = type(value)
        if kind is int or kind is float:
            return None if value < 0 else int(value)
        if kind is str and _DIGITS.fullmatch(value) and len(value) <= 40 and (n := int(value)) < 2 * LONG:
            return n
    return None


def _refuse(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    value = float(text)
    if value - value != 0:
        raise ValueError(text)
    return value


def object_parser() -> Callable[[str], dict | None]:
    """A function that gives the JSON object that a line is, with nothing after it; None if it is anything else. Of repeated keys the last counts."""
    parse = json.JSONDecoder(parse_constant=_refuse, parse_float=_finite).decode

    def parsed(line: str) -> dict | None:
        try:
            found = parse(line)
        except (ValueError, RecursionError):
            return None
        return found if type(found) is dict else None

    return parsed


def json_rows(fields: list[tuple[str, str]], keys: dict[str, tuple[str, ...]], limits: dict[str, int]) -> Callable:
    """A function of lines that gives a tuple per line, or None to skip it: blank, not an object, or without a time."""
    addresses, times, parse_object = _Cache(address), _Cache(time_ns), object_parser()
    plan = [(kind, keys[name], limits.get(name, LONG), name == "country") for name, kind in fields]

    def rows(lines: list[str | None]) -> list[tuple | None]:
        out: list[tuple | None] = []
        for line in lines:
            record = parse_object(line) if line else None
            if record is None:
                out.append(None)
                continue
            row = []
            for kind, names, limit, upper in plan:
                if kind == "uint":
                    value = first_uint(record, names)
                    if value is not None and value >= limit:
                        value = None
                else:
                    value = first_text(record, names)
                    if value is not None:
                        if kind == "ip":
                            value = addresses[value]
                        elif kind == "timestamp":
                            value = times[value]
                            if value is None:
                                break
                        elif upper:
                            value = value.translate(_UPPER)
                    elif kind == "timestamp":
                        break
                row.append(value)
            else:
                out.append(tuple(row))
                continue
            out.append(None)
        return out

    return rows


def clf_ns(text: str) -> int | None:
    """Nanoseconds of ``02/Jan/2006:15:04:05 -0700``."""
    m = _CLF_TIME.fullmatch(text)
    if not m or (month := _MONTHS.get(m[2].lower())) is None:
        return None
    day, hour, minute, second, hours, minutes = _days[f"{m[3]}-{month:02d}-{m[1]}"], int(m[4]), int(m[5]), int(m[6]), int(m[8]), int(m[9])
    if day is None or hour > 23 or minute > 59 or second > 59 or hours > 24 or minutes > 59:
        return None
    ns = (day + hour * 3600 + minute * 60 + second - (hours * 3600 + minutes * 60) * (1 if m[7] == "+" else -1)) * 1_000_000_000
    return ns if -LONG <= ns < LONG else None


def web_rows(limits: dict[str, int]) -> Callable:
    """A function of web log lines that gives a tuple per line, or None to skip it."""
    addresses, times = _Cache(address), _Cache(clf_ns)
    most_status, most_bytes = limits.get("status", LONG), limits.get("bytes", LONG)

    def number(text: str, most: int) -> int | None:
        return n if _DIGITS.fullmatch(text) and len(text) <= 40 and (n := int(text)) < most else None

    def rows(lines: list[str | None]) -> list[tuple | None]:
        out: list[tuple | None] = []
        for line in lines:
            text = line.strip(_BLANK) if line else ""
            if not text or text[0] == "#":
                out.append(None)
                continue
            token = [m[m.lastindex] for m in _CLF_TOKEN.finditer(text)]
            request = token[4].split(" ", 2) if len(token) >= 7 else ()
            ns = times[token[3]] if len(request) >= 2 else None
            if ns is None:
                out.append(None)
                continue
            said = [t if t not in ("", "-") else None for t in token[7:9]] if len(token) >= 9 else [None, None]
            out.append((ns, addresses[token[0]], request[0], request[1], number(token[5], most_status), number(token[6], most_bytes) or 0, *said))
        return out

    return rows


def texts(column: pa.Array) -> list[str | None]:
    """Values of a text column; bytes that are no UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # halves of surrogate pairs, which JSON escapes can spell
        return pa.array([v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else v for v in values], kind)


def decoder(rows: Callable[[], Callable], at: int, fields: list[tuple[str, pa.DataType]], numbered: bool) -> Callable:
    """For ``mapInArrow``: the batches with a struct ``record`` after their columns, null for a line to be skipped.

    ``numbered`` adds ``seq`` for streams: (batch, partition, line), which rises from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, line = rows(), 0
        base = _stream_base() if numbered else 0
        for batch in batches:
            found = decode(texts(batch.column(at)))
            blank = (None,) * len(fields)
            columns = zip(*(r or blank for r in found)) if found else [()] * len(fields)
            arrays = [_array(list(c), kind) for c, (_, kind) in zip(columns, fields)]
            mask = pa.array([r is None for r in found], pa.bool_())
            record = pa.StructArray.from_arrays(arrays, fields=[pa.field(n, k) for n, k in fields], mask=mask)
            extra = []
            if numbered:
                if line + len(found) > 1 << 23:
                    raise ValueError("a stream's partition holds more than 8,388,608 lines in a batch; make batches smaller")
                extra = [pa.array(range(base + line, base + line + len(found)), pa.int64())]
                line += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, record, *extra], names=[*batch.schema.names, "record", *(["seq"] if numbered else [])])

    return run


def _stream_base() -> int:
    """26 bits of batch, 14 of partition, 23 of line."""
    from pyspark import TaskContext

    task = TaskContext.get()
    batch = int((task.getLocalProperty("streaming.sql.batchId") if task else None) or 0)
    return (batch << 37) + ((task.partitionId() if task else 0) << 23)
