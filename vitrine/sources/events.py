"""Search history and clickstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.predicates import between

# Tags stored with a recorded search, after the application's own.
SURFACE = "storefront"
ROUTE_TAGS = ("surface:storefront", "route:search")
FIRST_PAGE_TAG = "page:first"


def event_time_ms(timestamp_ms: Column, timestamp_nanos: Column) -> Column:
    """Milliseconds, else nanoseconds cut down to milliseconds, else 0."""
    from_nanos = F.floor(timestamp_nanos.cast("decimal(20,0)") / 1_000_000).cast("long")
    return F.coalesce(timestamp_ms, from_nanos, F.lit(0).cast("long"))


def window_bounds_ms(to_ms: int, hours: int) -> tuple[int, int]:
    """Whole-second bounds of a trailing window ending at ``to_ms``."""
    to = to_ms // 1000 * 1000
    return to - hours * 3_600_000, to


def read_searches(
    history: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
    tag: str = FIRST_PAGE_TAG,
) -> DataFrame:
    """Recorded searches with ``tag``, in the window, with a text query.

    ``history`` holds event_id, trace_id, raw_query, top_result_ids, timestamp_ms,
    tags. A missing trace id becomes blank and a missing result list empty.
    """
    kept = history.filter(F.array_contains("tags", tag) & F.col("raw_query").isNotNull())
    kept = _in_window(kept, from_ms, to_ms)
    return kept.select(
        "event_id",
        F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        "raw_query",
        F.coalesce("top_result_ids", F.array().cast("array<string>")).alias("top_result_ids"),
        "timestamp_ms",
    )


def _in_window(events: DataFrame, from_ms: int | None, to_ms: int | None) -> DataFrame:
    if from_ms is not None:
        events = events.filter(F.col("timestamp_ms") >= from_ms)
    if to_ms is not None:
        events = events.filter(F.col("timestamp_ms") <= to_ms)
    return events


def read_clicks(
    clicks: DataFrame,
    searches: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Clicks of the traces that occur in ``searches``; blank traces never match."""
    traces = searches.select("trace_id").filter(F.col("trace_id") != "")
    kept = _in_window(clicks.filter(F.col("doc_id").isNotNull()), from_ms, to_ms)
    return kept.join(traces, "trace_id", "left_semi")


def clicks_between(
    clicks: DataFrame, from_ms: int | None = None, to_ms: int | None = None
) -> DataFrame:
    """Clicks on a document in the window, of any trace: a join with searches selects the traces."""
    return _in_window(clicks.filter(F.col("doc_id").isNotNull()), from_ms, to_ms)


def recorded_searches(requests: DataFrame, app_tag: str) -> DataFrame:
    """Requests that become search history: first pages of the storefront, tagged."""
    first_page = F.coalesce("cursor", F.lit("")) == ""
    return requests.filter((F.col("surface") == SURFACE) & first_page).withColumn(
        "tags", F.array(*[F.lit(t) for t in (app_tag, *ROUTE_TAGS, FIRST_PAGE_TAG)])
    )


def windowed(events: DataFrame, lo: int, hi: int, time: str = "timestamp_ms") -> DataFrame:
    """Half-open window for stored rows: lo < time <= hi."""
    return events.filter(between(F.col(time), lo, hi))
