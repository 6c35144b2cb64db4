"""Syntax tree of the query language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str  # one of = != =~ !~
    value: str


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Selector:
    name: str
    matchers: tuple[Matcher, ...] = ()
    range_ms: int | None = None


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    inner: object
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None
    k: int | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


def walk(node) -> Iterator[object]:
    yield node
    for child in getattr(node, "args", ()) or [getattr(node, f) for f in ("inner", "left", "right") if hasattr(node, f)]:
        yield from walk(child)


def longest_range(node) -> int:
    """The largest range of any selector in the tree, in milliseconds."""
    return max((n.range_ms or 0 for n in walk(node) if isinstance(n, Selector)), default=0)
