"""Trending queries: volume times click quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions import gain
from vitrine.functions.text import normalize_query, trending_row_id
from vitrine.operators.topk import top_k_per_key
from vitrine.session import settle

# Searches: event_id, trace_id, raw_query, top_result_ids, timestamp_ms.
# Clicks: trace_id, doc_id.


def keyed_searches(searches: DataFrame) -> DataFrame:
    """Searches with their aggregation key; rejected queries are gone."""
    return searches.withColumn("query", normalize_query(F.col("raw_query"))).filter(
        F.col("query").isNotNull()
    )


def search_groups(keyed: DataFrame) -> DataFrame:
    """Searches that share query, trace and result list, as one row.

    ``searches`` counts them, ``group_id`` is one of their event ids and ``first``
    the time and event of the earliest. All that follows works on these rows.
    """
    return keyed.groupBy("query", "trace_id", "top_result_ids").agg(
        F.count(F.lit(1)).alias("searches"),
        F.min("event_id").alias("group_id"),
        F.min(F.struct("timestamp_ms", "event_id")).alias("first"),
    )


def ranked_clicks(groups: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks attributed to result positions of each search group.

    Repeated clicks on one document are one row with ``clicks``. Both sides are
    shrunk before the join and a group meets only the documents it listed, so a
    trace that holds a large share of the log yields no product of its searches
    and clicks. A document listed twice counts at its last position.
    """
    ids = F.col("top_result_ids")
    placed = F.transform(
        F.array_distinct(ids),
        lambda d: F.struct(
            d.alias("doc_id"),
            (F.size(ids) - F.array_position(F.reverse(ids), d)).alias("rank"),
        ),
    )
    listed = (
        groups.filter(F.coalesce("trace_id", F.lit("")) != "")
        .select("query", "trace_id", "searches", "group_id", F.explode(placed).alias("p"))
        .select("query", "trace_id", "searches", "group_id", "p.doc_id", "p.rank")
    )
    clicked = (
        clicks.filter((F.coalesce("trace_id", F.lit("")) != "") & F.col("doc_id").isNotNull())
        .groupBy("trace_id", "doc_id")
        .agg(F.count(F.lit(1)).alias("clicks"))
    )
    return listed.join(clicked, ["trace_id", "doc_id"])


def search_quality(ranked: DataFrame) -> DataFrame:
    """NDCG of each search group that has at least one ranked click."""
    return (
        ranked.groupBy("query", "group_id", "searches")
        .agg(
            F.sum(F.col("clicks") * gain.gain_at(F.col("rank"))).alias("dcg"),
            F.sum("clicks").alias("clicks"),
        )
        .withColumn("ndcg", gain.ndcg_from_sums(F.col("dcg"), F.col("clicks")))
    )


def scored_queries(
    groups: DataFrame,
    clicks: DataFrame | None = None,
    quality_weight: float = 0.0,
    min_count: int = settings.TRENDING_MIN_COUNT,
) -> DataFrame:
    """Every query at or above the floor with ``count``, ``score`` and ``ndcg``."""
    counts = (
        groups.groupBy("query")
        .agg(F.sum("searches").alias("count"))
        .filter(F.col("count") >= min_count)
    )
    if quality_weight > 0 and clicks is not None:
        quality = (
            search_quality(ranked_clicks(groups, clicks))
            .groupBy("query")
            .agg(F.sum(F.col("searches") * F.col("ndcg")).alias("total"))
        )
        counts = counts.join(quality, "query", "left").select(
            "query",
            "count",
            F.coalesce(F.col("total") / F.col("count"), F.lit(0.0)).alias("ndcg"),
        )
    else:
        counts = counts.withColumn("ndcg", F.lit(0.0))
    score = F.col("count") * (F.lit(1.0) + F.lit(float(quality_weight)) * F.col("ndcg"))
    return counts.select("query", "count", score.alias("score"), "ndcg")


def sample_ids(
    groups: DataFrame,
    carried: list[str] | None = None,
    size: int = settings.SAMPLE_TOP_IDS,
) -> DataFrame:
    """First ``size`` distinct result ids of every query, as ``sample_top_ids``.

    Order is search time, event id, position. Ids are ranked before they are
    collected, so no query builds more than ``size`` entries. ``carried`` names
    further columns that depend on the query alone.
    """
    keys = carried or ["query"]
    seen = (
        groups.select(*keys, "first", F.posexplode_outer("top_result_ids").alias("pos", "doc_id"))
        .groupBy(*keys, "doc_id")
        .agg(F.min(F.struct("first.timestamp_ms", "first.event_id", "pos")).alias("met"))
    )
    order = [F.col("doc_id").isNull(), F.col("met"), F.col("doc_id")]
    kept = top_k_per_key(seen, ["query"], order, size, "place")
    listed = F.when(F.col("doc_id").isNotNull(), F.struct("place", "doc_id"))
    return kept.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(listed)), lambda s: s["doc_id"]).alias(
            "sample_top_ids"
        )
    )


def trending(
    searches: DataFrame,
    clicks: DataFrame | None = None,
    quality_weight: float = 0.0,
    min_count: int = settings.TRENDING_MIN_COUNT,
    top_n: int | None = settings.TRENDING_TOP_N,
) -> DataFrame:
    """``(query, count, score, ndcg, sample_top_ids)`` by score, then query.

    ``top_n=None`` keeps every query above the floor. The log is read once: its
    groups are settled, and counts, click quality and samples work on them. With
    ``top_n``, samples are only worked out for the winners.
    """
    groups = settle(search_groups(keyed_searches(searches)))
    entries = scored_queries(groups, clicks, quality_weight, min_count)
    order = [F.col("score").desc(), F.col("query")]
    if top_n is None:
        # Samples are one short row per query by the time they are joined.
        sampled = entries.join(sample_ids(groups), "query")
    else:
        entries = entries.orderBy(*order).limit(max(top_n, 0))
        if top_n <= settings.BROADCAST_LOOKUP_ROWS:
            # At most top_n short rows.
            entries = F.broadcast(entries)
        sampled = sample_ids(groups.join(entries, "query"), entries.columns)
    return sampled.orderBy(*order)


def trending_rows(entries: DataFrame, as_of_ms: int, source: str, job: str) -> DataFrame:
    """Rows as stored: keyed by query digest and stamped with their origin."""
    return entries.select(
        trending_row_id(F.col("query")).alias("id"),
        "query",
        "count",
        "score",
        "ndcg",
        "sample_top_ids",
        F.lit(as_of_ms).cast("long").alias("as_of"),
        F.lit(source).alias("_derived_from"),
        F.lit(job).alias("_derived_by"),
    )


def read_trending(table: DataFrame, limit: int = settings.TRENDING_TOP_N, quality_weight: float = 0.0) -> DataFrame:
    """Stored rows by score, then query; rows without a query are left out."""
    if not 1 <= limit <= settings.TRENDING_READ_LIMIT:
        raise ValueError(f"limit must be between 1 and {settings.TRENDING_READ_LIMIT}")
    return (
        table.filter(F.col("query").isNotNull())
        .select(
            "query",
            "count",
            "score",
            "ndcg",
            "sample_top_ids",
            F.lit("quality" if quality_weight > 0 else "frequency").alias("mode"),
        )
        .orderBy(F.col("score").desc(), F.col("query"))
        .limit(limit)
    )
