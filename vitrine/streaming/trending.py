"""Sliding trending windows and click attribution on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import normalize_query
from vitrine.operators.topk import top_k_per_key
from vitrine.streaming.runner import BATCH

LATENESS = "24 hours"


def sliding_counts(
    searches: DataFrame,
    window: str = "24 hours",
    slide: str = "1 hour",
    lateness: str = LATENESS,
) -> DataFrame:
    """``(window_start, window_end, query, count)`` of searches with an event time ``ts``.

    Counts are kept per slide first and then added up per window, so an event
    sits in one piece of state instead of one for each window it falls into.
    Works on streams (append mode) and on batches alike.
    """
    keyed = searches.select("ts", normalize_query(F.col("raw_query")).alias("query")).filter(
        F.col("query").isNotNull()
    )
    per_slide = (
        keyed.withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("slot"), "query")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_slide.groupBy(F.window(F.window_time("slot"), window, slide).alias("span"), "query")
        .agg(F.sum("n").alias("count"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "query",
            "count",
        )
    )


def slot_counts(searches: DataFrame, slide: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """``(slot_end, query, count)`` per slot, for a stream in update mode.

    A slot's count is out with the batch that changed it, long before the
    watermark has passed it.
    """
    return (
        searches.select("ts", normalize_query(F.col("raw_query")).alias("query"))
        .filter(F.col("query").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("slot"), "query")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("slot.end").alias("slot_end"), "query", "count")
    )


def current_counts(updates: DataFrame, window: str = "24 hours") -> DataFrame:
    """``(window_end, query, count)`` of the window that ends with the newest slot.

    ``updates`` are the written batches of ``slot_counts``; the last count of a
    slot holds.
    """
    newest = updates.agg(F.unix_micros(F.max("slot_end"))).first()[0]
    end = F.timestamp_micros(F.lit(newest).cast("long"))
    return (
        updates.filter(F.col("slot_end") > end - F.expr(f"interval {window}"))
        .groupBy("slot_end", "query")
        .agg(F.max_by("count", BATCH).alias("n"))
        .groupBy(end.alias("window_end"), "query")
        .agg(F.sum("n").alias("count"))
    )


def top_per_window(
    counts: DataFrame,
    min_count: int = settings.TRENDING_MIN_COUNT,
    top_n: int = settings.TRENDING_TOP_N,
) -> DataFrame:
    """Trending queries of every finished window, for a written count table."""
    return top_k_per_key(
        counts.filter(F.col("count") >= min_count),
        ["window_end"],
        [F.col("count").desc(), F.col("query")],
        top_n,
    )


def listed_documents(searches: DataFrame, lateness: str) -> DataFrame:
    """``(event_id, trace_id, query, ts, doc_id, rank)``: every document of every traced search once.

    A document listed twice counts at its last position.
    """
    ids = F.col("top_result_ids")
    placed = F.transform(
        F.array_distinct(ids),
        lambda d: F.struct(
            d.alias("doc_id"), (F.size(ids) - F.array_position(F.reverse(ids), d)).alias("rank")
        ),
    )
    return (
        searches.filter(F.coalesce("trace_id", F.lit("")) != "")
        .withWatermark("ts", lateness)
        .select(
            "event_id", "trace_id", normalize_query(F.col("raw_query")).alias("query"), "ts", F.explode(placed).alias("p")
        )
        .select("event_id", "trace_id", "query", "ts", "p.doc_id", "p.rank")
        .filter(F.col("query").isNotNull())
    )


def attributed_clicks(
    searches: DataFrame, clicks: DataFrame, lateness: str = LATENESS, bound: str = "24 hours"
) -> DataFrame:
    """Clicks joined to the result position they hit, as both streams arrive.

    ``searches`` has event_id, trace_id, raw_query, top_result_ids, ts; ``clicks``
    has event_id, trace_id, doc_id, ts. A search and a click may come in either
    order at most ``bound`` apart; that bound lets Spark drop old state. A
    document listed twice counts at its last position.
    """
    listed = listed_documents(searches, lateness).select(
        F.col("event_id").alias("search_id"), "trace_id", "query", F.col("ts").alias("search_ts"), "doc_id", "rank"
    )
    clicked = (
        clicks.filter((F.coalesce("trace_id", F.lit("")) != "") & F.col("doc_id").isNotNull())
        .withWatermark("ts", lateness)
        .select(
            F.col("event_id").alias("click_id"),
            F.col("trace_id").alias("c_trace_id"),
            F.col("doc_id").alias("c_doc_id"),
            F.col("ts").alias("click_ts"),
        )
    )
    match = F.expr(
        "trace_id = c_trace_id and doc_id = c_doc_id"
        f" and click_ts >= search_ts - interval {bound} and click_ts <= search_ts + interval {bound}"
    )
    return listed.join(clicked, match).select(
        "search_id", "click_id", "trace_id", "query", "doc_id", "rank", "search_ts", "click_ts"
    )
