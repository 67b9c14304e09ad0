"""Tokens of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..types import QueryError

_SPEC = re.compile(
    r"""(?P<blank>[ \t\r\n]+)
      | (?P<text>'(?:[^']|'')*')
      | (?P<punct>!=|[=<>(),*])
      | (?P<number>[0-9][0-9.]*)
      | (?P<ident>[A-Za-z_][A-Za-z0-9_.]*)""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str  # text, punct, number, ident, end
    value: str
    at: int


def tokens(statement: str) -> list[Token]:
    """All tokens with an ``end``; a number may hold many dots, so an IPv4 address needs no quotes."""
    out, at = [], 0
    while at < len(statement):
        m = _SPEC.match(statement, at)
        if m is None:
            what = "unterminated text" if statement[at] == "'" else f"unexpected character {statement[at]!r}"
            raise QueryError(f"{what} at {at}")
        if m.lastgroup != "blank":
            value = m[0][1:-1].replace("''", "'") if m.lastgroup == "text" else m[0]
            out.append(Token(m.lastgroup, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]
