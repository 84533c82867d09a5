"""Trees of the text algebra: relations and expressions."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, fields
from typing import Any


class AlgebraError(ValueError):
    """A query that the algebra does not accept."""


@dataclass(frozen=True)
class Name:
    """A column: plain, of a relation (``rel.c``), or of the scope-th enclosing binder (``0.c``)."""

    column: str
    relation: str | None = None
    scope: int | None = None


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str  # int fixed string date bool null
    type: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Substring:
    text: Any
    start: Any
    length: Any


@dataclass(frozen=True)
class Aggregate:
    """count sum avg min max; row_number is a window function of the same shape."""

    op: str
    arg: Any = None


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class First:
    """A scalar subquery."""

    query: Any


@dataclass(frozen=True)
class Relation:
    name: str


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Any, str], ...]
    source: Any


@dataclass(frozen=True)
class GroupBy:
    items: tuple[tuple[Any, str], ...]
    keys: tuple[Name, ...]
    source: Any


@dataclass(frozen=True)
class Filter:
    test: Any
    source: Any


@dataclass(frozen=True)
class Join:
    test: Any
    left: Any
    right: Any


@dataclass(frozen=True)
class DepJoin:
    """For each row of left, the rows of right with that row bound as scope 0."""

    left: Any
    right: Any


@dataclass(frozen=True)
class Dedup:
    source: Any


@dataclass(frozen=True)
class OrderBy:
    keys: tuple[tuple[Any, bool], ...]  # ascending?
    source: Any


@dataclass(frozen=True)
class Limit:
    count: int
    source: Any


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class One:
    """One row without columns; scalars are selected from it."""


@dataclass(frozen=True)
class Scalar:
    expr: Any
    name: str


@dataclass(frozen=True)
class Range:
    low: Any
    high: Any


@dataclass(frozen=True)
class ListOf:
    keys: Any
    values: Any


@dataclass(frozen=True)
class TupleOf:
    members: tuple[Any, ...]
    kind: str


@dataclass(frozen=True)
class HashIndex:
    keys: Any
    values: Any
    lookup: tuple[Any, ...]


@dataclass(frozen=True)
class Bound:
    """lower or upper; closed?"""

    expr: Any
    closed: bool


@dataclass(frozen=True)
class OrderedIndex:
    keys: Any
    values: Any
    bounds: tuple[tuple[Bound | None, Bound | None], ...]


@dataclass(frozen=True)
class Query:
    name: str
    args: tuple[tuple[str, str], ...]
    body: Any = field(default=None)


EXPRESSIONS = (Name, Literal, Unary, Binary, If, Substring, Aggregate, Exists, First)


def children(node: Any):
    """The nodes directly below."""
    for f in fields(node):
        yield from _nodes(getattr(node, f.name))


def _nodes(x: Any):
    if isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)
    elif hasattr(x, "__dataclass_fields__"):
        yield x


def rebuild(node: Any, change) -> Any:
    """The node with change() applied to each node below it."""

    def deep(x):
        if isinstance(x, tuple):
            return tuple(deep(y) for y in x)
        return change(x) if hasattr(x, "__dataclass_fields__") else x

    new = {f.name: deep(getattr(node, f.name)) for f in fields(node)}
    return type(node)(**new)


def conjuncts(e: Any) -> list[Any]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "&&" else [e]


def conjunction(parts: list[Any]) -> Any:
    if not parts:
        return Literal(True, "bool")
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = Binary("&&", p, out)
    return out


def has_aggregate(e: Any) -> bool:
    """Whether an expression aggregates, outside subqueries."""
    if isinstance(e, Aggregate):
        return e.op != "row_number"
    return not isinstance(e, (Exists, First)) and any(has_aggregate(c) for c in children(e))


def has_window(e: Any) -> bool:
    if isinstance(e, Aggregate):
        return e.op == "row_number"
    return not isinstance(e, (Exists, First)) and any(has_window(c) for c in children(e))


def literal(value: Any) -> Literal:
    """A literal of a Python value."""
    if value is None:
        return Literal(None, "null")
    if isinstance(value, bool):
        return Literal(value, "bool")
    if isinstance(value, int):
        return Literal(value, "int")
    if isinstance(value, float):
        return Literal(value, "fixed")
    if isinstance(value, datetime.date):
        return Literal(value, "date")
    return Literal(str(value), "string")
