"""Facet histograms and table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.operators.tables import side_by_side
from vitrine.session import settle


def facet_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, value, doc_count)`` of every declared field in one pass."""
    long = docs.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        [], fields, "field", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )


def field_sizes(
    docs: DataFrame, fields: list[str], max_distinct: int = settings.FACET_MAX_DISTINCT
) -> DataFrame:
    """``(field, distinct_values, skipped)``: fields too varied to serve are marked."""
    return (
        facet_counts(docs, fields)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
        .withColumn("skipped", F.col("distinct_values") > max_distinct)
    )


def facet_snapshot(
    docs: DataFrame, fields: list[str], max_distinct: int = settings.FACET_MAX_DISTINCT
) -> DataFrame:
    """Facet rows of the fields with at most ``max_distinct`` values."""
    # Written once: the sizes and the rows both read the grouped values.
    counts = settle(facet_counts(docs, fields))
    served = (
        counts.groupBy("field")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") <= max_distinct)
        .select("field")
    )
    # At most one row per declared field.
    return counts.join(F.broadcast(served), "field", "left_semi")


def table_metadata(docs: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """One row: row count, newest watermark and whether ingest is at rest.

    ``stability`` is the per-pipeline table of the stability gate; without it the
    table is not called stable.
    """
    summary = docs.agg(
        F.count(F.lit(1)).alias("row_count"), F.max("upserted_at").alias("stable_as_of")
    )
    if stability is None:
        return summary.withColumn("is_stable", F.lit(False))
    gate = stability.agg(F.coalesce(F.bool_and("stable"), F.lit(False)).alias("is_stable"))
    return side_by_side(summary, gate)
