"""Small filter trees turned into Column predicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "Eq": lambda c, v: c == v,
    "NotEq": lambda c, v: c != v,
    "Gt": lambda c, v: c > v,
    "Lte": lambda c, v: c <= v,
}


def comparisons(filters: Sequence[Any] | None) -> Iterator[Sequence[Any]]:
    """The ``[name, op, value]`` leaves of nested lists and ``And`` nodes."""
    if not filters:
        return
    if isinstance(filters[0], str) and filters[0] != "And":
        yield filters
        return
    for part in filters:
        if part != "And":
            yield from comparisons(part)


def predicate(filters: Sequence[Any] | None, filterable: set[str] | None = None) -> Column:
    """Column that is true where every comparison among ``filters`` is; true where there is none.

    ``filters`` is one comparison, a list of them or a tree of ``And`` nodes.
    ``filterable`` names the attributes a filter may use; a filter on any other
    column is refused while the plan is built.
    """

    def column(name: str, op: str, value: Any) -> Column:
        if op not in COMPARISONS:
            raise ValueError(f"unknown comparison {op!r}")
        if filterable is not None and name not in filterable:
            raise ValueError(f"attribute {name!r} is not filterable")
        return COMPARISONS[op](F.col(name), value)

    return reduce(Column.__and__, (column(*c) for c in comparisons(filters)), F.lit(True))


def between(c: Column, lo: Any, hi: Any) -> Column:
    """Half-open time window: lo < c <= hi."""
    return (c > lo) & (c <= hi)
