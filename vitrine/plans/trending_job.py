"""One tick of the trending reduce over whole logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vitrine import settings
from vitrine.operators import trending
from vitrine.sources import events
from vitrine.sources.versioned import VersionedTable


def trending_tick(
    history: DataFrame,
    clicks: DataFrame,
    to_ms: int,
    source: str,
    job: str,
    hours: int = settings.TRENDING_WINDOW_HOURS,
    quality_weight: float = 0.0,
    min_count: int = settings.TRENDING_MIN_COUNT,
    top_n: int | None = settings.TRENDING_TOP_N,
) -> DataFrame:
    """Rows to store for the window that ends at ``to_ms``.

    Clicks are only read when their quality counts.
    """
    from_ms, end_ms = events.window_bounds_ms(to_ms, hours)
    searches = events.read_searches(history, from_ms, end_ms)
    attributed = None
    if quality_weight > 0:
        attributed = events.clicks_between(clicks, from_ms, end_ms)
    entries = trending.trending(searches, attributed, quality_weight, min_count, top_n)
    return trending.trending_rows(entries, to_ms, source, job)


def write_tick(table: VersionedTable, rows: DataFrame, mode: str = "upsert") -> int | None:
    """Upsert the rows of a tick; a tick without rows writes nothing."""
    return table.upsert(rows, "id", mode)
