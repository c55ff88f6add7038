"""Reciprocal rank fusion, the featured blend and the personal rail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.operators.neighbours import all_neighbours
from vitrine.operators.topk import top_k_per_key
from vitrine.operators.vector_search import nearest_to_id
from vitrine.session import row_count_up_to, settle


def request_seeds(seeds: DataFrame, max_seeds: int = settings.FUSION_MAX_SEEDS) -> DataFrame:
    """``(request_id, leg, seed_id)``: distinct seeds in order, legs from 0.

    ``seeds`` has ``request_id``, ``pos`` and ``seed_id``. Blank seeds are ignored
    and a request with fewer than two seeds is dropped: there is nothing to fuse.
    """
    firsts = (
        seeds.filter(F.coalesce("seed_id", F.lit("")) != "")
        .groupBy("request_id", "seed_id")
        .agg(F.min("pos").alias("pos"))
    )
    legs = top_k_per_key(firsts, ["request_id"], [F.col("pos"), F.col("seed_id")], max_seeds, "leg")
    enough = (
        legs.groupBy("request_id")
        .count()
        .filter(F.col("count") >= settings.FUSION_MIN_SEEDS)
        .select("request_id")
    )
    return legs.join(enough, "request_id", "left_semi").select(
        "request_id", (F.col("leg") - 1).alias("leg"), "seed_id"
    )


def fuse(
    legs: DataFrame, hits: DataFrame, top_k: int = settings.FUSION_TOP_K
) -> DataFrame:
    """``(request_id, id, score, rank)`` from per-seed rankings.

    ``legs`` comes from ``request_seeds``; ``hits`` holds ``seed_id``, ``id`` and a
    ``rank`` from 1. Seeds of the request are excluded. Ties keep the order in
    which a document was first met, by leg and rank.
    """
    met = legs.join(hits, "seed_id").select(
        "request_id", "leg", "id", (F.col("rank") - 1).alias("place")
    )
    own = legs.select("request_id", F.col("seed_id").alias("id"))
    fused = (
        met.join(own, ["request_id", "id"], "left_anti")
        .groupBy("request_id", "id")
        .agg(
            F.sum(1.0 / (F.col("place") + (settings.RRF_CONSTANT + 1))).alias("score"),
            F.min(F.struct("leg", "place")).alias("first"),
        )
    )
    # Equal sums may differ in the last bits with the order of addition.
    fused = fused.withColumn("score", F.round("score", 12))
    return top_k_per_key(
        fused, ["request_id"], [F.col("score").desc(), F.col("first")], top_k
    ).drop("first")


def multi_seed(
    docs: DataFrame,
    seeds: DataFrame,
    top_k: int = settings.FUSION_TOP_K,
    per_seed: int = settings.FUSION_PER_SEED,
    max_seeds: int = settings.FUSION_MAX_SEEDS,
    broadcast_limit: int = settings.BROADCAST_REQUESTS,
) -> DataFrame:
    """Fused neighbours of several seeds per request.

    Each distinct seed is searched once, however many requests share it. Seeds
    too many to broadcast are answered through clustered cells.
    """
    # The legs are wanted three times: to size, to search and to fuse.
    legs = settle(request_seeds(seeds, max_seeds))
    distinct = legs.select("seed_id").distinct()
    if row_count_up_to(distinct, broadcast_limit) <= broadcast_limit:
        asked = distinct.withColumn("request_id", F.col("seed_id"))
        hits = nearest_to_id(docs, asked, per_seed, broadcast_limit=broadcast_limit)
    else:
        asked = distinct.select(F.col("seed_id").alias("id"))
        hits = all_neighbours(docs, per_seed, seeds=asked)
    ranked = hits.select(F.col("request_id").alias("seed_id"), "id", "rank")
    return fuse(legs, ranked, top_k)


def featured(
    hits: DataFrame,
    per_query: int = settings.FEATURED_PER_QUERY,
    total: int = settings.FEATURED_TOTAL,
) -> DataFrame:
    """``(place, id)``: query results in query order, first seen kept.

    ``hits`` holds ``query_pos``, ``rank`` (from 1) and ``id``.
    """
    firsts = (
        hits.filter(F.col("rank") <= per_query)
        .groupBy("id")
        .agg(F.min(F.struct("query_pos", "rank")).alias("first"))
    )
    cut = firsts.orderBy("first", "id").limit(total)
    return cut.select(
        F.col("first.query_pos").alias("query_pos"), F.col("first.rank").alias("rank"), "id"
    )


def featured_fallback(cards: DataFrame, total: int = settings.FEATURED_TOTAL) -> DataFrame:
    """Best rated cards, for when no query returned anything."""
    return cards.orderBy(F.col("rating").desc(), F.col("asin")).limit(total)
