"""Nodes of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Step:
    id: str
    where: Any = None
    args: tuple = ()
    rest: Any = None  # a Select with the order, limit and groups given in the brackets


@dataclass(frozen=True)
class Ref:
    steps: tuple[Step, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(s.id for s in self.steps)


@dataclass(frozen=True)
class Val:
    value: Any
    regex: bool = False


@dataclass(frozen=True)
class Enum:
    symbol: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple = ()
    named: tuple = ()
    distinct: bool = False
    over: Any = None


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: tuple = ()
    frame: tuple | None = None


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Neg:
    arg: Any


@dataclass(frozen=True)
class In:
    arg: Any
    items: Any  # tuple of expressions, or a query
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: Any = None


@dataclass(frozen=True)
class Cast:
    arg: Any
    type: str


@dataclass(frozen=True)
class Row:
    items: tuple


@dataclass(frozen=True)
class Exists:
    arg: Any  # Ref or query


@dataclass(frozen=True)
class Sub:
    query: Any


@dataclass(frozen=True)
class Item:
    """One entry of a select list. star: ``*``; expand and inline hold the items of a nested projection."""

    expr: Any = None
    alias: str | None = None
    star: bool = False
    expand: tuple | None = None
    inline: tuple | None = None
    excluding: tuple = ()
    where: Any = None
    order: tuple = ()
    limit: int | None = None
    offset: int = 0
    group: tuple = ()
    having: Any = None
    search: tuple = ()


@dataclass(frozen=True)
class Sort:
    expr: Any
    desc: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Table:
    """A source: a path (entity, then associations) or a query, with an alias."""

    ref: Ref | None = None
    path: tuple[Step, ...] = ()
    query: Any = None
    func: Any = None
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    how: str
    left: Any
    right: Any
    on: Any = None


@dataclass
class Select:
    source: Any = None
    items: tuple | None = None
    excluding: tuple = ()
    distinct: bool = False
    one: bool = False
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple = ()
    limit: int | None = None
    offset: int = 0
    search: tuple = ()
    localized: bool = False
    recurse: Any = None  # (association, condition)
    unions: list = field(default_factory=list)
    ctes: list = field(default_factory=list)
