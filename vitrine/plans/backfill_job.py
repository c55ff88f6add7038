"""Giving stored documents the blob reference they lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import blobs
from vitrine.session import settle
from vitrine.sources.scans import numbered_ids, scan_page


def inspected_ids(
    docs: DataFrame, ids: DataFrame | None, offset: int, max_docs: int | None
) -> DataFrame | None:
    """Ids to look at: the given ones, or a range of the id scan, or all (None)."""
    if ids is not None:
        return ids
    if offset <= 0 and max_docs is None:
        return None
    return scan_page(numbered_ids(docs), offset, max_docs).select("id")


def backfill(
    docs: DataFrame,
    namespace: str,
    fetch: Callable[[str], bytes] | None = None,
    ids: DataFrame | None = None,
    offset: int = 0,
    max_docs: int | None = None,
    blob_folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, statistics)``. Without ``fetch`` this only reports.

    Fetched bytes are written to ``blob_folder`` first, and only references to
    bytes that it holds are patched in; fetching without a folder is refused.
    """
    if fetch is not None and blob_folder is None:
        raise ValueError("fetched bytes need a blob_folder to be stored in")
    states = blobs.backfill_states(docs, inspected_ids(docs, ids, offset, max_docs))
    if fetch is None:
        return docs, blobs.backfill_statistics(states)
    fetched = settle(blobs.fetch_contents(blobs.backfill_candidates(states), fetch))
    contents = blobs.addressed(fetched, namespace)
    held = blobs.store_blobs(contents, blob_folder).select("sha")
    contents = contents.join(held.withColumn("_held", F.lit(True)), "sha", "left").withColumn(
        "ref", F.when(F.col("_held"), F.col("ref"))
    )
    stored = contents.select(
        "id", "ref", F.when(F.col("ref").isNotNull(), F.col("size")).alias("size")
    )
    return blobs.patch_refs(docs, stored), blobs.backfill_statistics(states, stored)
