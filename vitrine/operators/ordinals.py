"""Global row numbers and prefix sums without a one-partition window.

Rows are range-partitioned on a unique order, sorted inside each partition and
written to the checkpoint folder. Only one number per partition travels through
the driver; it comes back as a broadcast offset. The written copy fixes which
row sits where, so a lost executor cannot renumber anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import settle

PLACE = "_place"
PART = "_part"
# monotonically_increasing_id keeps the partition above bit 33.
PART_BITS = 33


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _placed(df: DataFrame, order: list[str | Column]) -> DataFrame:
    keys = _columns(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(ranged.withColumn(PLACE, F.monotonically_increasing_id())).withColumn(
        PART, F.shiftright(PLACE, PART_BITS)
    )


def _before(placed: DataFrame, amount: Column) -> tuple[dict[int, int], int]:
    """Amount held by all earlier partitions, per partition, and the grand total."""
    totals = placed.groupBy(PART).agg(amount.cast("long").alias("amount")).collect()
    running = 0
    before = {}
    for row in sorted(totals, key=lambda r: r[PART]):
        before[row[PART]] = running
        running += row["amount"] or 0
    return before, running


def with_ordinals(
    df: DataFrame, order: list[str | Column], name: str = "ordinal", total: str | None = None
) -> DataFrame:
    """Add a 0-based position in ``order``, which must be unique, and the number of rows as ``total``."""
    placed = _placed(df, order)
    before, rows = _before(placed, F.count(F.lit(1)))
    offsets = placed.sparkSession.createDataFrame(list(before.items()), f"{PART} long, _offset long")
    within = F.col(PLACE).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    counted = {total: F.lit(rows).cast("long")} if total else {}
    return (
        placed.join(F.broadcast(offsets), PART)
        .withColumns({name: F.col("_offset") + within, **counted})
        .drop(PART, PLACE, "_offset")
    )


def with_running_total(
    df: DataFrame, order: list[str | Column], value: str, name: str = "running_total"
) -> DataFrame:
    """Add the inclusive running sum of ``value`` in ``order``, which must be unique.

    Partitions of the written copy are read in their order, so they are summed
    where they lie.
    """
    placed = _placed(df, order)
    before, _total = _before(placed, F.sum(value))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            spot = batch.schema.get_field_index(PLACE)
            if running is None:
                running = before[batch.column(spot)[0].as_py() >> PART_BITS]
            values = pc.fill_null(batch.column(batch.schema.get_field_index(value)).cast(pa.int64()), 0)
            sums = pc.add(pc.cumulative_sum(values), running)
            running = sums[-1].as_py()
            kept = [i for i in range(batch.num_columns) if i != spot]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), sums], names=[*(batch.schema.names[i] for i in kept), name]
            )

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return placed.drop(PART).mapInArrow(summed, schema)
