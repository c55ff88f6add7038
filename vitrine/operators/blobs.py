"""Content-addressed blobs: storing, auditing, backfilling, budgeting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import blob_ref, blob_ref_digest, blob_ref_status, strip
from vitrine.operators.ordinals import with_running_total
from vitrine.operators.tables import fetch_by_ids, patch_columns, side_by_side

ALREADY, MISSING_URL, CANDIDATE, ABSENT = "already", "missing_url", "candidate", "absent"


def addressed(contents: DataFrame, namespace: str) -> DataFrame:
    """Contents with their digest, reference and size."""
    digest = F.sha2("content", 256)
    return (
        contents.withColumn("sha", digest)
        .withColumn("ref", blob_ref(namespace, F.col("sha")))
        .withColumn("size", F.length("content").cast("long"))
    )


def distinct_blobs(contents: DataFrame) -> DataFrame:
    """One row per digest, the one with the smallest id.

    The row is chosen on digest and id alone. The contents then meet the choice on
    both, so even a digest that a large share of the rows has is spread by id.
    """
    chosen = contents.groupBy("sha").agg(F.min("id").alias("id"))
    return contents.join(chosen, ["sha", "id"], "left_semi").dropDuplicates(["sha", "id"])


BLOB_SCHEMA = "sha string, content binary, size long"


def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """``(sha, content, size)`` of a blob folder, each digest once; empty before the first write."""
    try:
        rows = spark.read.schema(BLOB_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BLOB_SCHEMA)
    return rows.dropDuplicates(["sha"])


def store_blobs(contents: DataFrame, folder: str) -> DataFrame:
    """Append the bytes that the folder lacks; returns ``(sha, size)`` of all it holds.

    ``contents`` come from ``addressed``. Equal contents are written once. Two
    writers may both write a digest; readers see it once.
    """
    spark = contents.sparkSession
    held = stored_blobs(spark, folder).select("sha")
    fresh = distinct_blobs(contents.filter(F.col("sha").isNotNull())).join(held, "sha", "left_anti")
    fresh.select("sha", "content", "size").write.mode("append").parquet(folder)
    return stored_blobs(spark, folder).select("sha", "size")


def blob_state(image_blob: Column, image_url: Column) -> Column:
    """What a backfill has to do for one document."""
    has_blob = strip(F.coalesce(image_blob, F.lit(""))).startswith("blob://")
    has_url = strip(F.coalesce(image_url, F.lit(""))) != ""
    return F.when(has_blob, ALREADY).when(has_url, CANDIDATE).otherwise(MISSING_URL)


def backfill_states(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, image_url, state)`` of the inspected documents.

    With ``ids`` only those are inspected; an id without a document is absent.
    """
    if ids is None:
        rows = docs.select("id", "image_url", "image_blob", F.lit(True).alias("found"))
    else:
        rows = fetch_by_ids(docs, ids, ["image_url", "image_blob"])
    state = F.when(~F.col("found"), ABSENT).otherwise(
        blob_state(F.col("image_blob"), F.col("image_url"))
    )
    return rows.select("id", strip(F.col("image_url")).alias("image_url"), state.alias("state"))


def backfill_candidates(states: DataFrame) -> DataFrame:
    return states.filter(F.col("state") == CANDIDATE).select("id", "image_url")


def backfill_statistics(states: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``stored`` holds the outcome of each attempted document
    (``id``, ``size``; NULL size for a failure); without it this is a dry run."""
    state = F.col("state")
    inspected = states.agg(
        F.count(F.lit(1)).alias("inspected"),
        F.count_if(state != ABSENT).alias("fetched"),
        F.count_if(state == ALREADY).alias("already_backfilled"),
        F.count_if(state.isin(MISSING_URL, ABSENT)).alias("missing_image_url"),
        F.count_if(state == CANDIDATE).alias("attempted"),
    )
    if stored is None:
        return inspected.select(
            "*", *[F.lit(0).cast("long").alias(c) for c in ("patched", "failed", "bytes_stored")]
        )
    outcome = stored.agg(
        F.count_if(F.col("size").isNotNull()).alias("patched"),
        F.count_if(F.col("size").isNull()).alias("failed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_stored"),
    )
    return side_by_side(inspected, outcome)


def fetch_contents(rows: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """``(id, image_url, content, error)`` by calling ``fetch`` for each url.

    An exception or an empty body leaves ``content`` NULL and says why.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents: list[bytes | None] = []
            errors: list[str | None] = []
            for url in batch["image_url"]:
                try:
                    body = fetch(url)
                    contents.append(body or None)
                    errors.append(None if body else "empty body")
                except Exception as error:  # noqa: BLE001 - any failure is an outcome
                    contents.append(None)
                    errors.append(type(error).__name__)
            yield batch.assign(content=contents, error=errors)

    return rows.select("id", "image_url").mapInPandas(
        run, "id string, image_url string, content binary, error string"
    )


def patch_refs(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents with the new references of the rows that were stored."""
    done = stored.filter(F.col("ref").isNotNull())
    return patch_columns(
        docs, done.select("id", F.col("ref").alias("image_blob")), version=[F.col("image_blob")]
    )


def referenced(docs: DataFrame) -> DataFrame:
    """``(id, status, sha)`` of every document's blob reference."""
    ref = F.col("image_blob")
    return docs.select("id", blob_ref_status(ref).alias("status"), blob_ref_digest(ref).alias("sha"))


def reference_audit(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: documents, references, malformed ones, and blobs found or missing.

    ``blobs`` holds ``sha`` and ``size``. References are counted per digest first,
    so a widely shared image does not skew the join.
    """
    refs = referenced(docs)
    totals = refs.agg(
        F.count(F.lit(1)).alias("documents_scanned"),
        F.count_if(F.col("status") != "none").alias("refs_seen"),
        F.count_if(F.col("status") == "invalid").alias("invalid_refs"),
    )
    digests = refs.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.count(F.lit(1)).alias("refs"))
    matched = digests.join(blobs.select("sha", "size"), "sha", "left").agg(
        F.count_if(F.col("size").isNotNull()).alias("objects"),
        F.coalesce(F.sum(F.when(F.col("size").isNull(), F.col("refs"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )
    return side_by_side(totals, matched)


def budget_prefix(docs: DataFrame, blobs: DataFrame, budget: int) -> DataFrame:
    """Blobs in id order of their first document until ``budget`` bytes are used.

    Returns every referenced blob with ``running_total`` and ``chosen``.
    """
    firsts = (
        referenced(docs)
        .filter(F.col("sha").isNotNull())
        .groupBy("sha")
        .agg(F.min("id").alias("id"))
    )
    sized = firsts.join(blobs.select("sha", "size"), "sha")
    totalled = with_running_total(sized.select("id", "sha", "size"), ["id", "sha"], "size")
    return totalled.withColumn("chosen", F.col("running_total") <= budget)


def budget_summary(prefix: DataFrame) -> DataFrame:
    """One row: blobs and bytes chosen and whether the budget ran out."""
    chosen = F.col("chosen")
    return prefix.agg(
        F.count_if(chosen).alias("objects"),
        F.coalesce(F.sum(F.when(chosen, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.bool_or(~chosen), F.lit(False)).alias("budget_exhausted"),
    )
