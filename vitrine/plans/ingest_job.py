"""From raw catalog rows to the indexed product table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import blobs, embedding, products, slices, tables
from vitrine.session import settle
from vitrine.sources.versioned import VersionedTable


def stage(
    rows: DataFrame,
    order: list[str | Column],
    offset: int = 0,
    limit: int = -1,
    indexed: DataFrame | None = None,
    raw: str = "v",
) -> DataFrame:
    """Chunks of one slice of valid products, skipping what is indexed.

    ``order`` is the unique source order of the raw rows.
    """
    keep = [c for c in order if isinstance(c, str)]
    valid = products.normalize_products(rows, raw, keep)
    if offset > 0 or limit >= 0:
        # Range partitioning reads its input twice; normalising is worth doing once.
        valid = slices.take_slice(slices.numbered(settle(valid), order), offset, limit)
    chunks = products.stage_chunks(valid, order)
    return chunks if indexed is None else tables.skip_existing(chunks, indexed)


def embed_and_index(
    table: VersionedTable,
    chunks: DataFrame,
    fetch: Callable[[str], bytes],
    encoder: embedding.ImageEncoder,
    namespace: str,
    upserted_at_ms: int,
    blob_folder: str,
) -> DataFrame:
    """Fetch, embed and upsert staged chunks; returns the outcome of every id.

    Of several chunks of one id the last in the source's order holds. The fetched
    images are settled once, so neither a retry nor the several uses below fetch
    them again; their bytes are written to ``blob_folder`` before any reference to them.
    """
    chunks = settle(tables.one_per_key(chunks, version=tables.last_written(chunks)))
    claims = embedding.triage(chunks, chunks)
    ready = claims.filter(F.col("outcome") == embedding.READY).select(
        "id", F.col("metadata.image_url").alias("image_url")
    )
    fetched = settle(blobs.fetch_contents(ready, fetch))
    embedded = settle(embedding.embed_images(fetched, encoder))
    done = embedded.filter(F.col("outcome") == embedding.OK)
    refs = blobs.addressed(fetched.join(done.select("id"), "id", "left_semi"), namespace)
    refs = refs.join(blobs.store_blobs(refs, blob_folder).select("sha"), "sha", "left_semi")
    if not done.isEmpty():
        held = table.read() if table.exists() else chunks.select("id").limit(0)
        table.write(embedding.write_vectors(held, chunks, done, refs, upserted_at_ms))
    unready = claims.filter(F.col("outcome") != embedding.READY).select("id", "outcome")
    return unready.unionByName(embedded.select("id", "outcome"))
