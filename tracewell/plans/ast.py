"""Statements of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Compare:
    """A column against literals; ``op`` is one of = != < > in. Literals carry no type until they are bound."""

    column: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Either:
    left: Predicate
    right: Predicate


Predicate = Compare | Both | Either


@dataclass(frozen=True)
class Count:
    pass


@dataclass(frozen=True)
class Top:
    column: str
    n: int = 10


@dataclass(frozen=True)
class Rows:
    """All columns (``*``) if none are named; a column may be named twice."""

    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Statement:
    select: Count | Top | Rows = field(default_factory=Rows)
    where: Predicate | None = None
    limit: int = 0  # 0: none given


def leaves(predicate: Predicate | None) -> list[Compare]:
    if predicate is None:
        return []
    return [predicate] if isinstance(predicate, Compare) else leaves(predicate.left) + leaves(predicate.right)
