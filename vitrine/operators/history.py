"""Latest distinct views and searches per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import collapse
from vitrine.operators.topk import top_k_per_key


def recent_views(views: DataFrame, limit: int = settings.MAX_VIEWS) -> DataFrame:
    """``(user_id, doc_id, ts_ms, event_id, place)``, newest first, place from 1.

    ``views`` holds ``event_id``, ``user_id``, ``doc_id``, ``ts_ms``. Views fold to
    one row per user and document before anything is ranked.
    """
    latest = (
        views.filter(F.col("doc_id").isNotNull())
        .groupBy("user_id", "doc_id")
        .agg(F.max(F.struct("ts_ms", "event_id")).alias("at"))
    )
    kept = top_k_per_key(latest, ["user_id"], [F.col("at").desc(), F.col("doc_id")], limit, "place")
    return kept.select("user_id", "doc_id", "at.ts_ms", "at.event_id", "place")


def recent_searches(searches: DataFrame, limit: int = settings.MAX_RECENT_SEARCHES) -> DataFrame:
    """``(user_id, query, ts_ms, event_id, place)``, newest first.

    Queries that differ only in case or spacing are one entry with the newest
    spelling.
    """
    shown = searches.withColumn("query", collapse(F.col("raw_query"))).filter(
        F.col("query").isNotNull()
    )
    latest = (
        shown.groupBy("user_id", F.lower("query").alias("_key"))
        .agg(F.max(F.struct(F.col("timestamp_ms").alias("ts_ms"), "event_id", "query")).alias("at"))
    )
    kept = top_k_per_key(latest, ["user_id"], [F.col("at").desc()], limit, "place")
    return kept.select("user_id", "at.query", "at.ts_ms", "at.event_id", "place")


def rail_seeds(views: DataFrame, max_seeds: int = settings.RAIL_SEEDS) -> DataFrame:
    """Seed rows ``(request_id, pos, seed_id)`` of every user's newest views."""
    return recent_views(views, max_seeds).select(
        F.col("user_id").alias("request_id"),
        F.col("place").alias("pos"),
        F.col("doc_id").alias("seed_id"),
    )
