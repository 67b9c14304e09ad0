import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.plans.ast import Both, Compare, Count, Either, Rows, Statement, Top
from tracewell.plans.binder import bind
from tracewell.plans.parser import parse
from tracewell.types import QueryError, TracewellError


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT * FROM t", Statement()),
        ("select count(*) from t", Statement(Count())),
        ("SELECT top(dstport) FROM t", Statement(Top("dstport", 10))),
        ("SELECT TOP(a.b, 3) FROM t LIMIT 7", Statement(Top("a.b", 3), None, 7)),
        ("SELECT a, b, a FROM t WHERE a = 'it''s'", Statement(Rows(("a", "b", "a")), Compare("a", "=", ("it's",)))),
        ("SELECT * FROM t WHERE ip = 203.0.113.5", Statement(Rows(), Compare("ip", "=", ("203.0.113.5",)))),
        ("SELECT * FROM t WHERE p IN (22, '80') LIMIT 0", Statement(Rows(), Compare("p", "in", ("22", "80")))),
        ("SELECT x, count FROM t", Statement(Rows(("x", "count")))),
    ],
)
def test_accepted(text, want):
    assert parse(text) == want


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "SELECT FROM t", "SELECT count FROM t", "SELECT count(x) FROM t", "SELECT top() FROM t", "SELECT top(a, 0) FROM t", "SELECT top(a, 1.5) FROM t", "SELECT a, count(*) FROM t", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a", "SELECT * FROM t WHERE a <= 3", "SELECT * FROM t WHERE a <> 3", "SELECT * FROM t WHERE a = b", "SELECT * FROM t WHERE a = 'x", "SELECT * FROM t WHERE a IN ()", "SELECT * FROM t WHERE (a = 1", "SELECT * FROM t LIMIT -1", "SELECT * FROM t LIMIT 1.0", "SELECT * FROM t LIMIT 1 x", "SELECT * FROM t; x", "SELECT * FROM t WHERE a ! 1", "SELECT * FROM t WHERE ip = ::1"],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_precedence():
    a, b, c = (Compare(x, "=", ("1",)) for x in "abc")
    assert parse("SELECT * FROM t WHERE a=1 OR b=1 AND c=1").where == Either(a, Both(b, c))
    assert parse("SELECT * FROM t WHERE (a=1 OR b=1) AND c=1").where == Both(Either(a, b), c)


@given(st.text(max_size=60))
def test_never_crashes(text):
    for prefix in ("", "SELECT * FROM t WHERE "):
        try:
            parse(prefix + text)
        except TracewellError:
            pass


@pytest.mark.parametrize(
    ("logical", "text", "want"),
    [
        ("port", "22", 22), ("port", "-1", None), ("port", "+1", None), ("port", "2.0", None), ("port", "ssh", None), ("uint", "18446744073709551615", 2**64 - 1), ("uint", "18446744073709551616", None),
        ("bool", "true", 1), ("bool", "0", 0), ("bool", "yes", None), ("enum", "22", "22"), ("ip", "1.2.3", None), ("ip", "01.2.3.4", None),
        ("ip", "203.0.113.5", bytes.fromhex("00000000000000000000ffffcb007105")), ("ip", "fe80::1%eth0", bytes.fromhex("fe800000000000000000000000000001")),
        ("timestamp", "1970-01-01", 0), ("timestamp", "1970-01-01T00:00:00.000000001Z", 1), ("timestamp", "1970-01-01 00:00:01", 10**9), ("timestamp", "1970-01-01T02:00:00+02:00", 0),
        ("timestamp", "2024", 2024), ("timestamp", "2024-6-1", None), ("timestamp", "2024-13-01", None), ("timestamp", "1969-12-31T23:59:59.5Z", -500_000_000), ("timestamp", "1.5", None), ("double", "0.5", 0.5),
    ],
)
def test_bind(logical, text, want):
    assert bind(logical, text) == want
