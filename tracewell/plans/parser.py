"""Statement text to ``Statement``.

    SELECT * | count(*) | top(column[, n]) | column, ... FROM name [WHERE predicate] [LIMIT n]

Predicates compare a column with =, !=, <, > or IN (...), joined by AND (tighter) and OR, with
parentheses. Keywords ignore case; the table name is not used; functions are known only as the
first and only selected item.
"""

from __future__ import annotations

from ..types import QueryError
from .ast import Both, Compare, Count, Either, Predicate, Rows, Statement, Top
from .lexer import Token, tokens


class _Stream:
    def __init__(self, text: str):
        self.items = tokens(text)
        self.at = 0

    @property
    def head(self) -> Token:
        return self.items[self.at]

    def take(self, kind: str, what: str) -> str:
        if self.head.kind != kind:
            raise QueryError(f"expected {what} at {self.head.at}, found {self.head.value!r}")
        self.at += 1
        return self.items[self.at - 1].value

    def word(self, keyword: str) -> bool:
        hit = self.head.kind == "ident" and self.head.value.lower() == keyword
        self.at += hit
        return hit

    def mark(self, sign: str) -> bool:
        hit = self.head.kind == "punct" and self.head.value == sign
        self.at += hit
        return hit

    def must(self, done: bool, what: str) -> None:
        if not done:
            raise QueryError(f"expected {what} at {self.head.at}, found {self.head.value!r}")


def parse(text: str) -> Statement:
    s = _Stream(text)
    s.must(s.word("select"), "SELECT")
    select = _selected(s)
    s.must(s.word("from"), "FROM")
    s.take("ident", "a table name")
    where = _any_of(s) if s.word("where") else None
    limit = _whole(s.take("number", "a number after LIMIT"), "LIMIT", 0) if s.word("limit") else 0
    s.must(s.head.kind == "end", "the end of the statement")
    return Statement(select, where, limit)


def _whole(text: str, what: str, least: int) -> int:
    if "." in text or int(text) < least:
        raise QueryError(f"{what} takes a whole number of {least} or more, not {text!r}")
    return int(text)


def _selected(s: _Stream) -> Count | Top | Rows:
    if s.mark("*"):
        return Rows()
    name = s.take("ident", "a select list")
    if name.lower() == "count":
        s.must(s.mark("(") and s.mark("*") and s.mark(")"), "count(*)")
        return Count()
    if name.lower() == "top":
        s.must(s.mark("("), "( after top")
        column = s.take("ident", "a column in top()")
        n = _whole(s.take("number", "a number in top()"), "top", 1) if s.mark(",") else Top(column).n
        s.must(s.mark(")"), ")")
        return Top(column, n)
    columns = [name]
    while s.mark(","):
        columns.append(s.take("ident", "a column"))
    return Rows(tuple(columns))


def _any_of(s: _Stream) -> Predicate:
    out = _all_of(s)
    while s.word("or"):
        out = Either(out, _all_of(s))
    return out


def _all_of(s: _Stream) -> Predicate:
    out = _single(s)
    while s.word("and"):
        out = Both(out, _single(s))
    return out


def _single(s: _Stream) -> Predicate:
    if s.mark("("):
        inner = _any_of(s)
        s.must(s.mark(")"), ")")
        return inner
    column = s.take("ident", "a column")
    if s.word("in"):
        s.must(s.mark("("), "( after IN")
        values = [_literal(s)]
        while s.mark(","):
            values.append(_literal(s))
        s.must(s.mark(")"), ")")
        return Compare(column, "in", tuple(values))
    for op in ("=", "!=", "<", ">"):
        if s.mark(op):
            return Compare(column, op, (_literal(s),))
    raise QueryError(f"expected a comparison at {s.head.at}, found {s.head.value!r}")


def _literal(s: _Stream) -> str:
    """Quoted text or a number: the column alone decides what it means."""
    if s.head.kind not in ("text", "number"):
        raise QueryError(f"expected a value at {s.head.at}, found {s.head.value!r}")
    s.at += 1
    return s.items[s.at - 1].value
