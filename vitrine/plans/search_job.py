"""Search, recommendation and featured jobs over tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import blank_to_null, strip
from vitrine.operators import drops, fusion, products
from vitrine.operators.embedding import TextEncoder, embed_texts
from vitrine.operators.history import rail_seeds
from vitrine.operators.vector_search import search_with_count, vector_top_k


def refused_requests(
    requests: DataFrame,
    checkpoints: DataFrame,
    lookup: int | None = settings.CHECKPOINT_LOOKUP,
) -> DataFrame:
    """``(request_id, error)`` of the requests that ``search`` cannot answer.

    Their label is not among the newest ``lookup`` checkpoints (None: among all).
    """
    asked = requests.select("request_id", "label").filter(F.col("label").isNotNull())
    return (
        drops.resolve_labels(asked, checkpoints, lookup)
        .filter(~F.col("known"))
        .select("request_id", F.concat(F.lit("unknown catalog checkpoint: "), "label").alias("error"))
    )


def text_requests(
    requests: DataFrame,
    checkpoints: DataFrame | None,
    encoder: TextEncoder,
    lookup: int | None = settings.CHECKPOINT_LOOKUP,
) -> DataFrame:
    """Requests with a vector and their drop window.

    ``requests`` holds ``request_id``, ``query`` and optionally ``category`` and
    ``label``. Blank queries and unknown labels drop out here; a blank query with
    a label is a browse request, see ``drops.browse_page``, and an unknown label
    has its row in ``refused_requests``.
    """
    clean = requests.withColumn("query", blank_to_null(strip(F.col("query")))).filter(
        F.col("query").isNotNull()
    )
    if checkpoints is not None and "label" in requests.columns:
        resolved = drops.resolve_labels(clean, checkpoints, lookup)
        clean = resolved.filter(F.col("known") | F.col("label").isNull()).drop("known")
    return embed_texts(clean, encoder, "query", "vector")


def search(
    docs: DataFrame,
    requests: DataFrame,
    encoder: TextEncoder,
    checkpoints: DataFrame | None = None,
    k: int = settings.SEARCH_TOP_K,
    max_distance: float | None = None,
    lookup: int | None = settings.CHECKPOINT_LOOKUP,
) -> DataFrame:
    """Ranked ids per text request; with ``max_distance`` also the count rows."""
    wanted = text_requests(requests, checkpoints, encoder, lookup)
    if max_distance is not None:
        return search_with_count(docs, wanted, k, max_distance)
    return vector_top_k(docs, wanted, k)


def with_attributes(hits: DataFrame, docs: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Hits with the stored attributes named in ``include``, all of them without it."""
    return hits.join(products.project_attributes(docs.drop("vector"), include), "id")


def with_cards(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the display columns of their documents."""
    shown = products.cards(docs.drop("vector")).withColumnRenamed("asin", "id")
    return hits.join(shown, "id")


def featured(
    docs: DataFrame,
    queries: DataFrame,
    encoder: TextEncoder,
) -> DataFrame:
    """Front-page blend of several queries ``(query_pos, query)``."""
    wanted = queries.withColumnRenamed("query_pos", "request_id")
    hits = search(docs, wanted, encoder, k=settings.FEATURED_PER_QUERY)
    return fusion.featured(hits.withColumnRenamed("request_id", "query_pos"))


def personal_rails(docs: DataFrame, views: DataFrame, **limits: int) -> DataFrame:
    """Items like each user's latest views, for all users in one job."""
    return fusion.multi_seed(docs, rail_seeds(views), **limits)
