"""Embedding a table with a user-supplied encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import strip
from vitrine.operators.products import vector_attributes
from vitrine.operators.tables import last_written, one_per_key, upsert

READY, RETRY, FAILED, OK = "ready", "retry", "failed", "ok"

# An encoder factory runs once per task and returns a function from a list of
# inputs to a matrix with one row per input.
TextEncoder = Callable[[], Callable[[list[str]], np.ndarray]]
ImageEncoder = Callable[[], Callable[[list[bytes]], np.ndarray]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def hashed_tokens_encoder(size: int = 64) -> TextEncoder:
    """Deterministic text encoder: signed token hashes added up into ``size`` slots."""

    def build() -> Callable[[list[str]], np.ndarray]:
        seen: dict[str, tuple[int, float]] = {}

        def slot(token: str) -> tuple[int, float]:
            if token not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
                number = int.from_bytes(digest, "little")
                seen[token] = (number % size, 1.0 if number >> 63 else -1.0)
            return seen[token]

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for row, text in enumerate(texts):
                for token in re.findall(r"\w+", text.lower()):
                    place, sign = slot(token)
                    out[row, place] += sign
            return out

        return encode

    return build


def hashed_bytes_encoder(size: int = 64) -> ImageEncoder:
    """Deterministic stand-in for an image model: byte histogram of the content."""

    def build() -> Callable[[list[bytes]], np.ndarray]:
        def encode(images: list[bytes]) -> np.ndarray:
            rows = [
                np.bincount(np.frombuffer(image, dtype=np.uint8) % size, minlength=size)
                for image in images
            ]
            return np.asarray(rows, dtype=np.float64)

        return encode

    return build


def embed_texts(
    df: DataFrame, encoder: TextEncoder, text: str = "text", output: str = "vector"
) -> DataFrame:
    """Add the unit vector of a text column; the encoder loads once per task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for texts in batches:
            vectors = _unit(np.asarray(run(texts.fillna("").tolist()), dtype=np.float64))
            yield pd.Series(list(vectors.astype(np.float32)))

    # Marked so that a filter on the vector does not plan the encoder a second time.
    return df.withColumn(output, encode.asNondeterministic()(F.col(text)))


def triage(claims: DataFrame, chunks: DataFrame, read_errors: DataFrame | None = None) -> DataFrame:
    """Claimed ids with ``outcome``: ready, retry after a read error, else failed.

    A claim fails when it has no chunk or its chunk has no image url.
    """
    joined = claims.select("id").join(
        chunks.select("id", "metadata", F.lit(True).alias("_chunk")), "id", "left"
    )
    errored: Column = F.lit(False)
    if read_errors is not None:
        joined = joined.join(
            read_errors.select("id", F.lit(True).alias("_error")).distinct(), "id", "left"
        )
        errored = F.coalesce("_error", F.lit(False))
    url = strip(F.coalesce("metadata.image_url", F.lit("")))
    outcome = (
        F.when(errored, RETRY)
        .when(F.col("_chunk").isNull() | (url == ""), FAILED)
        .otherwise(READY)
    )
    return joined.select("id", "metadata", outcome.alias("outcome"))


def embed_images(
    rows: DataFrame, encoder: ImageEncoder, batch: int = settings.EMBED_BATCH
) -> DataFrame:
    """``(id, vector, outcome)`` for rows ``(id, content)``.

    Images go to the model in micro-batches. If one of them is absent or the
    model fails, the whole micro-batch is to be retried.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        step = max(1, batch)
        for frame in frames:
            contents = frame["content"].tolist()
            vectors: list[np.ndarray | None] = []
            outcomes: list[str] = []
            for start in range(0, len(contents), step):
                part = contents[start : start + step]
                try:
                    if any(not c for c in part):
                        raise ValueError("image without content")
                    found = _unit(np.asarray(encode([bytes(c) for c in part]), dtype=np.float64))
                    vectors.extend(found.astype(np.float32))
                    outcomes.extend([OK] * len(part))
                except Exception:  # noqa: BLE001 - a model error is an outcome
                    vectors.extend([None] * len(part))
                    outcomes.extend([RETRY] * len(part))
            yield pd.DataFrame({"id": frame["id"], "vector": vectors, "outcome": outcomes})

    return rows.select("id", "content").mapInPandas(
        run, "id string, vector array<float>, outcome string"
    )


def write_vectors(
    table: DataFrame, chunks: DataFrame, embedded: DataFrame, refs: DataFrame, upserted_at_ms: int
) -> DataFrame:
    """Product table after upserting the embedded rows with their attributes.

    ``refs`` gives the blob reference of each id and ``upserted_at_ms`` the
    stamp. Of several chunks of one id the last in the source's order holds.
    """
    chunks = one_per_key(chunks, version=last_written(chunks))
    fresh = embedded.filter(F.col("outcome") == OK).select("id", "vector")
    rows = (
        vector_attributes(chunks)
        .drop("image_blob")
        .join(fresh, "id")
        .join(refs.select("id", F.col("ref").alias("image_blob")), "id", "left")
        .withColumn("upserted_at", F.lit(upserted_at_ms).cast("long"))
    )
    return upsert(table, rows)


def derive(
    reduce: Callable[..., DataFrame],
    sources: list[DataFrame],
    target: DataFrame,
    key: str = "id",
    mode: str = "upsert",
    version: list[Column] | None = None,
) -> DataFrame:
    """Derived table after one tick of a user function over whole tables."""
    return upsert(target, reduce(*sources), key, version, mode)


def undiscovered(table: DataFrame, marker: str) -> DataFrame:
    """Rows a derived column has not been filled for yet."""
    return table.filter(F.col(marker).isNull())
