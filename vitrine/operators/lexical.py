"""Token ranking over titles and descriptions, and hybrid similar items."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import tokens
from vitrine.operators import blockwise
from vitrine.operators.inverted import token_hits
from vitrine.operators.topk import top_k_per_key
from vitrine.operators.vector_search import equal_codes
from vitrine.session import broadcast_if_small, settle

# Weights of the two rankings.
TITLE_WEIGHT = 4.0
CATEGORY_WEIGHT = 3.0
TEXT_WEIGHT = 1.0
# What one token can add at most.
MOST_WEIGHT = TITLE_WEIGHT + CATEGORY_WEIGHT + TEXT_WEIGHT
RATING_COUNT_WEIGHT = 0.4
RATING_WEIGHT = 0.5
RATING_CENTRE = 4.0
SAME_CATEGORY_WEIGHT = 5.0
PRICE_WEIGHT = 1.5


def _token_table(requests: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens and how often each request repeats them."""
    lists = requests.column("tokens").combine_chunks()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    known = pc.unique(flat)
    counts = np.zeros((len(known), requests.num_rows))
    if len(flat):
        np.add.at(counts, (pc.index_in(flat, value_set=known).to_numpy(), owner), 1.0)
    return known, counts


def _presence(texts: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """1.0 where a text contains a token as a substring; equal texts are looked at once."""
    coded = texts.combine_chunks().dictionary_encode()
    found = np.zeros((len(coded.dictionary), len(known)))
    for place, token in enumerate(known.to_pylist()):
        held = pc.match_substring(coded.dictionary, token)
        found[:, place] = held.to_numpy(zero_copy_only=False).astype(np.float64)
    return found[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class SimilarScorer:
    """Same category, shared title tokens and price closeness to a seed item."""

    doc_columns = ["category", "low_text", "price"]
    request_columns = ["tokens", "seed_id", "seed_category", "seed_price"]
    ascending = False

    def pack(self, requests: pa.Table) -> dict[str, Any]:
        known, counts = _token_table(requests)
        seeds = requests.column("seed_id")
        categories = requests.column("seed_category")
        packed = {
            "known": known,
            "counts": counts,
            "ids": pc.unique(seeds).drop_null(),
            "categories": pc.unique(categories).drop_null(),
            "price": requests.column("seed_price").fill_null(np.nan).to_numpy(),
        }
        packed["seed"] = _place(seeds, packed["ids"], -2)
        packed["category"] = _place(categories, packed["categories"], -2)
        return packed

    def score(self, packed: dict[str, Any], docs: pa.Table) -> np.ndarray:
        scores = TEXT_WEIGHT * (_presence(docs.column("low_text"), packed["known"]) @ packed["counts"])
        held = _place(docs.column("category"), packed["categories"], -1)
        scores += SAME_CATEGORY_WEIGHT * (held[:, None] == packed["category"][None, :])
        price = docs.column("price").fill_null(np.nan).to_numpy()[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.minimum(price, packed["price"]) / np.maximum(price, packed["price"])
        scores += PRICE_WEIGHT * np.nan_to_num(near)
        own = _place(docs.column("id"), packed["ids"], -1)
        scores[own[:, None] == packed["seed"][None, :]] = np.nan
        return scores

    def cut(self, packed: dict[str, Any], low: int, high: int) -> dict[str, Any]:
        """A tile's requests, with the tokens and categories that they have."""
        counts = packed["counts"][:, low:high]
        tokens_held = np.flatnonzero(counts.any(axis=1))
        held, code = np.unique(packed["category"][low:high], return_inverse=True)
        wanted = np.zeros((len(code), len(held)))
        wanted[np.arange(len(code)), code] = SAME_CATEGORY_WEIGHT
        wanted[:, held < 0] = 0.0
        return {
            "tokens": tokens_held,
            "categories": held,
            # Small whole numbers, exact in single precision.
            "wants": np.hstack([TEXT_WEIGHT * counts[tokens_held].T, wanted]).astype(np.float32),
            "seed": packed["seed"][low:high],
            "price": packed["price"][low:high],
        }

    def load(self, packed: dict[str, Any], docs: pa.Table) -> dict[str, Any]:
        price = docs.column("price").fill_null(np.nan).to_numpy()
        lowest = min(np.nanmin(price, initial=np.inf), np.nanmin(packed["price"], initial=np.inf))
        return {
            "presence": _presence(docs.column("low_text"), packed["known"]).astype(np.float32),
            "category": _place(docs.column("category"), packed["categories"], -1),
            "own": _place(docs.column("id"), packed["ids"], -1),
            "price": price,
            # What the prices can add at most: without bound where some are negative.
            "room": PRICE_WEIGHT if lowest >= 0 else np.inf,
        }

    def rough(self, packed: dict[str, Any], loaded: dict[str, Any], low: int, high: int) -> np.ndarray:
        """Everything but the prices, which add at most ``room``."""
        same = loaded["category"][low:high, None] == packed["categories"][None, :]
        has = np.hstack([loaded["presence"][low:high, packed["tokens"]], same.astype(np.float32)])
        found = packed["wants"] @ has.T
        found[equal_codes(packed["seed"], loaded["own"][low:high])] = np.nan
        return found

    def floors(self, loaded: dict[str, Any], bounds: np.ndarray) -> np.ndarray:
        return -bounds - loaded["room"]

    def least(self, loaded: dict[str, Any], rough: np.ndarray) -> np.ndarray:
        return rough.astype(np.float64) - loaded["room"] - 2 * blockwise.HALF_PLACE

    def ceilings(self, packed: dict[str, Any], loaded: dict[str, Any]) -> None:
        return None

    def costs(
        self, packed: dict[str, Any], loaded: dict[str, Any], request: np.ndarray, doc: np.ndarray, rough: np.ndarray
    ) -> np.ndarray:
        mine, other = loaded["price"][doc], packed["price"][request]
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.minimum(mine, other) / np.maximum(mine, other)
        return -(rough.astype(np.float64) + PRICE_WEIGHT * np.nan_to_num(near))


def _place(values: pa.ChunkedArray, known: pa.Array, absent: int) -> np.ndarray:
    spot = pc.index_in(values, value_set=known)
    if isinstance(spot, pa.ChunkedArray):
        spot = spot.combine_chunks()
    return spot.fill_null(absent).to_numpy(zero_copy_only=False)


def _pool(pool: DataFrame) -> DataFrame:
    """Scoring columns; ``pool`` holds id, title, description, category, rating, rating_count."""
    title, text, category = (F.coalesce(c, F.lit("")) for c in ("title", "description", "category"))
    popularity = RATING_COUNT_WEIGHT * F.log10(F.col("rating_count") + 1) + RATING_WEIGHT * (
        F.col("rating") - RATING_CENTRE
    )
    return pool.select(
        F.col("id"),
        F.lower(title).alias("low_title"),
        F.lower(category).alias("low_category"),
        F.lower(F.concat_ws(" ", title, text, category)).alias("low_text"),
        popularity.alias("popularity"),
    )


def _bags(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bag, request_id)`` and ``(bag, token, times)``; queries of the same tokens are one bag."""
    asked = queries.select("request_id", tokens(F.col("query")).alias("tokens")).filter(F.size("tokens") > 0)
    asked = asked.withColumn("bag", F.array_join(F.array_sort("tokens"), " "))
    words = asked.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("token"))
    return asked.select("bag", "request_id"), words.groupBy("bag", "token").agg(F.count(F.lit(1)).alias("times"))


def _bag_scores(hits: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """``(bag, id, score)`` of matching documents, those that cannot be among the best ``k`` left out.

    ``hits`` holds token, id, weight and popularity. The k-th best document of
    any one token bounds a bag's k-th best from below, and a hit that stays
    below that bound with all other tokens at their most is not passed on.
    """
    score = F.col("weight") + F.col("popularity")
    best = top_k_per_key(hits.select("token", "id", score.alias("score")), ["token"], [F.col("score").desc()], k)
    floors = best.filter(F.col("rank") == k).select("token", F.col("score").alias("floor"))
    bounds = (
        words.join(floors, "token", "left")
        .groupBy("bag")
        .agg(F.max("floor").alias("floor"), F.sum(F.col("times") * MOST_WEIGHT).alias("most"))
    )
    # A token that most documents hold would be one key of a join of both sides' rows.
    asked = broadcast_if_small(settle(words.join(bounds, "bag")))
    reach = (
        F.col("popularity") + F.col("times") * F.col("weight") + F.col("most") - F.col("times") * MOST_WEIGHT
    )
    # Scores are rounded before they are compared.
    near = F.col("floor").isNull() | (reach >= F.col("floor") - 10.0**-settings.DIST_PLACES)
    return (
        hits.join(asked, "token")
        .filter(near)
        .groupBy("bag", "id")
        .agg((F.sum(F.col("times") * F.col("weight")) + F.max("popularity")).alias("score"))
    )


def lexical_top_k(pool: DataFrame, queries: DataFrame, k: int = settings.LEXICAL_TOP_K) -> DataFrame:
    """``(request_id, id, score, rank)`` for each query with at least one token.

    ``pool`` holds a unique id, title, description, category, rating and
    rating_count; ``queries`` holds ``request_id`` and ``query``. A document
    that matches no token still scores by its popularity, so the ``k`` most
    popular ones stand by for every query. Only scores above 0 count, and a
    document without ratings has none.
    """
    rated = _pool(pool).filter(F.col("popularity").isNotNull() & ~F.isnan("popularity"))
    requests, words = _bags(queries)
    words = settle(words)
    found = token_hits(rated, words, "low_title", "low_category")
    # The category is a part of the text, so a token that is the category has a hit there.
    weight = (
        TEXT_WEIGHT
        + F.when(F.col("in_title"), TITLE_WEIGHT).otherwise(0.0)
        + F.when(F.col("is_category"), CATEGORY_WEIGHT).otherwise(0.0)
    )
    hits = settle(found.select("token", "id", "popularity", weight.alias("weight")))
    matched = _bag_scores(hits, words, k)
    liked = rated.filter("popularity > 0").select("id", "popularity")
    rounded = F.round("popularity", settings.DIST_PLACES)
    # At most k rows.
    standing = liked.orderBy(rounded.desc(), "id").limit(k).collect()
    scores = matched
    if standing:
        listed = F.array(*(F.struct(F.lit(r["id"]).alias("id"), F.lit(r["popularity"]).alias("score")) for r in standing))
        stood_by = words.select("bag").distinct().select("bag", F.inline(listed))
        scores = matched.unionByName(stood_by).groupBy("bag", "id").agg(F.max("score").alias("score"))
    ranked = top_k_per_key(
        scores.filter("score > 0").withColumn("score", F.round("score", settings.DIST_PLACES)),
        ["bag"],
        [F.col("score").desc(), F.col("id")],
        k,
    )
    return requests.join(ranked, "bag").select("request_id", "id", "score", "rank")


def popular(pool: DataFrame, k: int = settings.LEXICAL_TOP_K) -> DataFrame:
    """Answer to a query without tokens: most rated first, ties by id."""
    return pool.select("id", "rating_count").orderBy(F.col("rating_count").desc(), "id").limit(k)


def similar_items(
    pool: DataFrame, seeds: DataFrame, k: int = settings.SIMILAR_TOP_K, **limits: int
) -> DataFrame:
    """``(request_id, id, score, rank)`` of items like each seed.

    ``pool`` holds id, title, description, category, price; ``seeds`` holds
    ``request_id`` and ``seed_id``. An unknown seed has no rows.
    """
    stored = pool.select(
        F.col("id").alias("seed_id"),
        tokens(F.coalesce("title", F.lit(""))).alias("tokens"),
        F.col("category").alias("seed_category"),
        F.col("price").alias("seed_price"),
    )
    requests = seeds.join(stored, "seed_id")
    docs = pool.select(
        "id",
        "category",
        F.lower(
            F.concat_ws(
                " ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
            )
        ).alias("low_text"),
        "price",
    )
    return blockwise.score_top_k(docs, requests, SimilarScorer(), k, **limits)
