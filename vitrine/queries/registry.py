"""Collects queries and their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, *, sql: str | None = None, covers: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name`` with its DuckDB check, if SQL can state one."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")

        @wraps(run)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            return run(ship_package(spark), folder)

        ENTRIES[name] = Entry(shipped, sql, tuple(covers.split()))
        return run

    return add


def entries() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from vitrine.queries import catalog, ingest, maintenance, personal, search, streams, trending  # noqa: F401

    return ENTRIES
