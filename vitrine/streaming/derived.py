"""Derived rows that follow the writes of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from vitrine.sources.versioned import VersionedTable


def derive_on_write(
    written: DataFrame,
    function: Callable[[DataFrame], DataFrame],
    target: VersionedTable,
    progress: str,
    key: str = "id",
    version: list[Column] | None = None,
) -> None:
    """Apply ``function`` to every batch of newly written rows and upsert the result.

    The function sees the rows of one batch. Rows are upserted by ``key``, of
    several the first by ``version``, so a batch that runs again after a failure leaves the same table.
    """

    def one(batch: DataFrame, _batch_id: int) -> None:
        target.upsert(function(batch), key, version=version)

    running = (
        written.writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(one)
        .start()
    )
    running.awaitTermination()
