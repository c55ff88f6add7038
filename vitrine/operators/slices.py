"""Offset slices of a catalog and the jobs that cover it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import percent_decode, percent_encode
from vitrine.operators.ordinals import with_ordinals

SCHEDULED_PREFIX = "index:scheduled:"
REFRESH_PREFIX = "refresh:"


def numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Valid rows with their position in source order."""
    return with_ordinals(rows, order, "ordinal")


def take_slice(rows: DataFrame, offset: int = 0, limit: int = -1) -> DataFrame:
    """Rows of one slice of a numbered table; a negative limit has no end."""
    start = max(offset, 0)
    taken = rows.filter(F.col("ordinal") >= start)
    return taken if limit < 0 else taken.filter(F.col("ordinal") < start + limit)


def plan_slices(requests: DataFrame, job_size: int = settings.SLICE_ROWS) -> DataFrame:
    """``(category, row_offset, row_limit)`` slices of each request row.

    Requests hold ``category``, ``row_offset`` and ``count``. A count of 0 gives no
    slice and -1 one slice without end; anything below, a negative offset or a
    job size below 1 is an error.
    """
    if job_size <= 0:
        raise ValueError("job_size must be positive")
    count, offset = F.col("count"), F.col("row_offset")
    checked = F.when(
        (count < -1) | (offset < 0), F.raise_error(F.lit("count or row_offset out of range"))
    ).otherwise(count)
    steps = (
        F.when(checked == 0, F.array().cast("array<bigint>"))
        .when(checked == -1, F.array(F.lit(0).cast("bigint")))
        .otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1, F.lit(job_size).cast("bigint")))
    )
    others = [c for c in requests.columns if c not in ("count", "row_offset")]
    return requests.select(*others, offset.alias("_from"), count.alias("_count"), F.explode(steps).alias("_at")).select(
        *others,
        (F.col("_from") + F.col("_at")).alias("row_offset"),
        F.when(F.col("_count") == -1, F.lit(-1).cast("bigint"))
        .otherwise(F.least(F.lit(job_size).cast("bigint"), F.col("_count") - F.col("_at")))
        .alias("row_limit"),
    )


def scheduled_ids(slices: DataFrame, run_label: Column) -> DataFrame:
    """Slices with a deterministic id that codes the run and the range."""
    coded = F.concat_ws(
        ":",
        percent_encode(run_label),
        percent_encode(F.col("category")),
        F.col("row_offset").cast("string"),
        F.col("row_limit").cast("string"),
    )
    return slices.withColumn("id", F.concat(F.lit(SCHEDULED_PREFIX), coded))


def parse_scheduled_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """``run_label``, ``category``, ``row_offset``, ``row_limit`` and ``status`` of each id.

    ``other`` is not a scheduled id at all; ``invalid`` has the prefix but not the
    parts.
    """
    c = F.col(column)
    parts = F.split(c, ":", 6)
    offset = F.get(parts, F.lit(4)).try_cast("bigint")
    limit = F.get(parts, F.lit(5)).try_cast("bigint")
    status = (
        F.when(~c.startswith(SCHEDULED_PREFIX), "other")
        .when((F.size(parts) == 6) & offset.isNotNull() & limit.isNotNull(), "ok")
        .otherwise("invalid")
    )
    good = status == "ok"
    return ids.select(
        *ids.columns,
        status.alias("status"),
        F.when(good, percent_decode(F.get(parts, F.lit(2)))).alias("run_label"),
        F.when(good, percent_decode(F.get(parts, F.lit(3)))).alias("category"),
        F.when(good, offset).alias("row_offset"),
        F.when(good, limit).alias("row_limit"),
    )


def refresh_id(label: Column) -> Column:
    return F.concat(F.lit(REFRESH_PREFIX), percent_encode(label))


def refresh_label(document_id: Column) -> Column:
    """Run label of a refresh id, NULL for any other id."""
    coded = F.substring(document_id, len(REFRESH_PREFIX) + 1, 2**31 - 1)
    return F.when(document_id.startswith(REFRESH_PREFIX), percent_decode(coded))


def assign_slices(rows: DataFrame, offset: int, job_size: int) -> DataFrame:
    """Slice number of each numbered row from ``offset`` on."""
    return rows.filter(F.col("ordinal") >= offset).withColumn(
        "slice", F.floor((F.col("ordinal") - offset) / job_size)
    )
