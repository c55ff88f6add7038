"""Resumable id scans and byte sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.ordinals import with_ordinals


def numbered_ids(docs: DataFrame) -> DataFrame:
    """Every id with its position in id order and the ``total``; the basis of a resumable scan."""
    return with_ordinals(docs.select("id"), ["id"], "position", "total")


def scan_page(numbered: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Ids of one page with ``next_offset`` and ``total``.

    ``limit=None`` reads to the end; a negative offset counts as 0.
    """
    start = max(0, offset)
    page = numbered.filter(F.col("position") >= start)
    end = F.col("total")
    if limit is not None:
        page = page.filter(F.col("position") < start + max(0, limit))
        end = F.least(end, F.lit(start + max(0, limit)).cast("long"))
    return page.select("id", "position", end.alias("next_offset"), "total")


def read_files(
    spark: SparkSession, folder: str, pattern: str = "*", wanted: DataFrame | None = None
) -> DataFrame:
    """``(id, content, error)`` of files, ``id`` being the name without its ending.

    Spark passes over files without content, so a failure only shows against the
    ids in ``wanted``: each of those has a row, with an error if nothing was read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    found = files.select(name.alias("id"), "content")
    if wanted is not None:
        found = wanted.select("id").distinct().join(found, "id", "left")
    return found.withColumn("error", F.when(F.col("content").isNull(), "empty or absent"))
