import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.ip import format_ip, in_network, normalize_ip, pack_ip
from tracewell.functions.text import ascii_upper, human_bytes, split_clf, trim_blank, unzigzag, uvarint_len, zigzag
from tracewell.functions.timeparse import clf_time_ns, epoch_to_ns, format_ns, parse_time_ns, to_timestamp_us


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("v")).alias("x")).collect())]


ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "", "x", "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "1:2:3:4::5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "::1.2.3.400", "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4%z", "12345::", ":1", "1:", "1.2.3.4:80", "g::1", "0:0:1:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:0:2:0:3:0:4:0", ":::"]


def test_addresses_match_the_literal_rules(spark):
    got = column(spark, [*ADDRESSES, None], normalize_ip)
    assert [None if g is None else bytes(g) for g in got] == [pack_ip(a) for a in ADDRESSES] + [None]


def test_address_text(spark):
    rng = random.Random(5)
    packed = [ipaddress.IPv6Address(a).packed for a in ("::", "::1", "1::", "1:0:0:2:0:0:0:3", "0:0:1:0:0:0:0:1", "1:0:2:0:3:0:4:0", "1:2:3:4:5:6:7:0", "0:2:3:4:5:6:7:8")]
    packed += [b"".join(rng.choice((b"\0\0", b"\0\1", b"\xab\xcd")) for _ in range(8)) for _ in range(200)]
    want = [str(ipaddress.IPv6Address(p)) if not p.startswith(bytes(10) + b"\xff\xff") else str(ipaddress.IPv4Address(p[12:])) for p in packed]
    assert column(spark, [bytearray(p) for p in packed], format_ip, "binary") == want
    assert column(spark, [bytearray(pack_ip("203.0.113.5")), bytearray(b"abc"), None], format_ip, "binary") == ["203.0.113.5", "?", None]
    assert column(spark, ["203.0.113.5"], lambda c: F.hex(normalize_ip(c))) == ["00000000000000000000FFFFCB007105"]
    assert column(spark, ["10.1.2.3", "10.2.0.0", "::1"], lambda c: in_network(normalize_ip(c), "10.1.0.0/16")) == [True, False, False]


def test_times(spark):
    ns = 1_717_200_000_123_456_789
    cases = {
        "2024-06-01T00:00:00.123456789Z": ns, "2024-06-01T02:00:00.123456789+02:00": ns, "2024-06-01 00:00:00": 1_717_200_000 * 10**9, "2024-06-01T00:00:00": 1_717_200_000 * 10**9, "1717200000": 1_717_200_000 * 10**9,
        "1717200000123": 1_717_200_000_123 * 10**6, "1717200000123456": 1_717_200_000_123_456 * 1000, "1717200000123456789": ns, "1717200000.9": 1_717_200_000 * 10**9, "1969-12-31T23:59:59Z": -(10**9), "1970-01-01T00:00:00.000000001Z": 1,
        "2024-13-01T00:00:00Z": None, "2024-06-01": None, "soon": None, "": None, "2024-06-01T00:00:00 Z": None, "99999999999": 99_999_999_999 * 10**9 if 99_999_999_999 * 10**9 < 2**63 else None,
    }
    assert column(spark, list(cases), parse_time_ns) == list(cases.values())
    assert column(spark, [ns, 0, 1, -1, -500_000_000, 1_717_200_000 * 10**9], format_ns, "bigint") == ["2024-06-01T00:00:00.123456789Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "1969-12-31T23:59:59.999999999Z", "1969-12-31T23:59:59.5Z", "2024-06-01T00:00:00Z"]
    assert column(spark, ["01/Jun/2024:02:00:00 +0200", "1/Jun/2024:00:00:00 +0000", "01/Xyz/2024:00:00:00 +0000"], clf_time_ns) == [1_717_200_000 * 10**9, None, None]
    assert column(spark, [5, 99_999_999_999], epoch_to_ns, "bigint") == [5 * 10**9, None]
    assert column(spark, [-1], lambda c: F.unix_micros(to_timestamp_us(c)), "bigint") == [-1]


@pytest.mark.parametrize(("line", "want"), [('a "b c" [d] e', ["a", "b c", "d", "e"]), ('"open end', ["open end"]), ("[x y", ["x y"]), ('a""b', ['a""b']), ('"" []', ["", ""]), ('"a"b c', ["a", "b", "c"]), ("  ", []), ('"a" "b"', ["a", "b"])])
def test_clf_tokens(spark, line, want):
    assert column(spark, [line], split_clf) == [want]


def test_small_ones(spark):
    assert column(spark, ["straße é us"], ascii_upper) == ["STRAßE é US"]
    assert column(spark, [" \t x  \r\n"], trim_blank) == ["x "]
    values = [0, 1, -1, 127, 128, 16383, 16384, 2**62, -(2**63), 2**63 - 1]
    assert column(spark, values, lambda c: unzigzag(zigzag(c)), "bigint") == values
    assert column(spark, [0, 127, 128, 16383, 16384, 2**56 - 1, 2**56, 2**63 - 1, -1], uvarint_len, "bigint") == [1, 1, 2, 2, 3, 8, 9, 9, 10]
    assert [human_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 20)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB"]


def test_a_newline_is_part_of_the_text(spark):
    assert column(spark, ["2024-06-01T00:00:00Z\n", "1717200000\n", "1.5\n"], parse_time_ns) == [None] * 3
    assert column(spark, ["01/Jun/2024:02:00:00 +0200\n"], clf_time_ns) == [None]
    assert column(spark, ["1.2.3.4\n", "::1\n", "::1.2.3.4\n", "1.2.3.4\r"], normalize_ip) == [None] * 4
