"""Incremental catalog refresh with labelled, idempotent runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.predicates import between
from vitrine.operators import pipeline_status, products, slices, tables
from vitrine.session import settle
from vitrine.sources.bucketed import BucketedTable
from vitrine.sources.catalog import SOURCE_ORDER, numbered_lines, with_files
from vitrine.sources.versioned import VersionedTable

CHECKPOINT_COLUMNS = "label string, watermark_ms long, row_count long"


def known_label(checkpoints: VersionedTable, label: str) -> bool:
    if not checkpoints.exists():
        return False
    return not checkpoints.read().filter(F.col("label") == label).isEmpty()


def next_rows(
    valid: DataFrame,
    order: list[str | Column],
    checkpoints: VersionedTable,
    count: int = settings.REFRESH_ROWS,
) -> DataFrame:
    """The ``count`` valid products after those that earlier checkpoints took."""
    cursor = 0
    if checkpoints.exists():
        cursor = pipeline_status.refresh_cursor(checkpoints.read()).first()["row_cursor"]
    return slices.take_slice(slices.numbered(valid, order), cursor, count)


def activate_checkpoint(
    checkpoints: VersionedTable,
    label: str,
    watermark_ms: int,
    row_count: int,
    gate: DataFrame | None = None,
) -> bool:
    """Append a checkpoint unless its label is taken or a pipeline is not at rest."""
    if gate is not None and not pipeline_status.all_stable(gate).first()["stable"]:
        return False
    if known_label(checkpoints, label):
        return False
    row = checkpoints.spark.createDataFrame([(label, watermark_ms, row_count)], CHECKPOINT_COLUMNS)
    checkpoints.upsert(row, "label")
    return True


def index_batch(
    chunks: DataFrame, table: VersionedTable | BucketedTable, upserted_at_ms: int
) -> int:
    """Upsert new chunks as documents and return how many there were.

    Of several chunks of one id the last in the source's order holds.
    """
    last = settle(tables.one_per_key(chunks, version=tables.last_written(chunks)))
    fresh = products.vector_attributes(last)
    stored = table.beside(fresh)
    if stored is not None:
        fresh = tables.skip_existing(fresh, stored)
    fresh = settle(fresh.withColumn("upserted_at", F.lit(upserted_at_ms).cast("long")))
    count = fresh.count()
    if count:
        table.upsert(fresh)
    return count


def refresh_once(
    valid: DataFrame,
    order: list[str | Column],
    table: VersionedTable | BucketedTable,
    checkpoints: VersionedTable,
    label: str,
    upserted_at_ms: int,
    count: int = settings.REFRESH_ROWS,
    gate: DataFrame | None = None,
) -> int | None:
    """One scheduled run: the next rows, the ones already indexed skipped.

    The checkpoint records the rows taken from the source, so the cursor moves on
    past skipped ones too. A label that is already there makes the run a no-op
    (None).
    """
    if known_label(checkpoints, label):
        return None
    taken = settle(next_rows(valid, order, checkpoints, count))
    indexed = index_batch(products.stage_chunks(taken, order), table, upserted_at_ms)
    activate_checkpoint(checkpoints, label, upserted_at_ms, taken.count(), gate)
    return indexed


def catalog_stream(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder as a stream of VARIANT rows ``v`` with ``file`` and ``block``."""
    reader = (
        spark.readStream.schema("v variant")
        .option("singleVariantColumn", "v")
        .option("mode", "FAILFAST")
    )
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return with_files(reader.json(folder))


def run_refresh(
    rows: DataFrame,
    table: VersionedTable | BucketedTable,
    checkpoints: VersionedTable,
    progress: str,
    label_of: Callable[[int], str],
    time_of: Callable[[int], int],
    gate: Callable[[], DataFrame] | None = None,
) -> None:
    """Drain a stream of raw rows (``v``, ``category``) into the product table.

    Rows of one id in one batch need the columns of ``catalog_stream`` that give
    their order.
    Every micro-batch is one labelled run. A batch that is repeated after a
    failure finds its label or its rows in place and changes nothing. What a run
    that the gate refuses has added belongs to the next checkpoint that it lets
    through, whose window and row count start at the newest one before.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        label = label_of(batch_id)
        if known_label(checkpoints, label):
            return
        order = []
        if {"file", "block"} <= set(batch.columns):
            # A stream has no row numbers; its batches do.
            batch, order = numbered_lines(batch), SOURCE_ORDER
        chunks = products.stage_chunks(products.normalize_products(batch, keep=order), order)
        index_batch(chunks, table, time_of(batch_id))
        newest = 0
        if checkpoints.exists():
            newest = checkpoints.read().agg(F.coalesce(F.max("watermark_ms"), F.lit(0))).first()[0]
        added = 0
        if table.exists():
            added = table.read().filter(between(F.col("upserted_at"), newest, time_of(batch_id))).count()
        activate_checkpoint(
            checkpoints, label, time_of(batch_id), added, gate() if gate else None
        )

    running = (
        rows.writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(one)
        .start()
    )
    running.awaitTermination()
