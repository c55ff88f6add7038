"""Catalog metadata files: where they are and how they are read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import fold_case, strip

# Columns of read_in_order that give the order of the source.
SOURCE_ORDER = ["file", "block", "line"]
CONFIG_PREFIX = "raw_meta_"


def category_files(names: DataFrame, revision: str = "main") -> DataFrame:
    """``names`` (``pos``, ``category``) with ``domain``, the name files go by, and ``file``.

    A category may come with or without the configuration prefix.
    """
    domain = F.regexp_replace(
        F.regexp_replace(strip(F.col("category")), f"^{CONFIG_PREFIX}", ""), " ", "_"
    )
    token = F.regexp_replace(F.lit(revision), r"[^\p{L}\p{N}._-]", "_")
    return names.withColumn("domain", domain).withColumn(
        "file", F.concat(F.lit("meta_"), "domain", F.lit("."), token, F.lit(".jsonl"))
    )


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines as VARIANT column ``v``; a malformed line fails the job.

    Blank lines are skipped. Keeping the row as a VARIANT preserves whether a
    field was text, a number, a list or an object.
    """
    return (
        spark.read.option("singleVariantColumn", "v").option("mode", "FAILFAST").json(paths)
    )


def read_in_order(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``read_catalog`` with ``file``, ``block`` and ``line``, which order the rows as the files do.

    ``block`` is where the part of a file that a task read begins; ``line`` grows
    inside it and is not a line number.
    """
    return numbered_lines(with_files(read_catalog(spark, paths)))


def with_files(rows: DataFrame) -> DataFrame:
    """Rows ``v`` straight from files, or a stream of files, with ``file`` and ``block``."""
    return rows.select(
        "v", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def numbered_lines(rows: DataFrame) -> DataFrame:
    """``line`` for rows that are still where they were read."""
    return rows.withColumn("line", F.monotonically_increasing_id())


def read_categories(
    spark: SparkSession,
    folder: str,
    categories: list[str],
    revision: str = "main",
    layout: str = "{file}",
) -> DataFrame:
    """One scan over the files of several categories, tagged with ``category``.

    ``category`` is spelled as requested; the path only tells which it was.
    ``layout`` says where below ``folder`` the file or folder of a category lies.
    """
    if not categories:
        raise ValueError("at least one category is required")
    listed = spark.createDataFrame(list(enumerate(categories)), "pos int, category string")
    files = category_files(listed, revision).orderBy("pos").collect()
    names = {r["domain"]: r["category"].strip() for r in files}
    paths = {f"{folder.rstrip('/')}/{layout.format(file=r['file'])}": None for r in files}
    ending = "." + files[0]["file"].removeprefix(f"meta_{files[0]['domain']}.")
    rows = read_catalog(spark, list(paths)).withColumn(
        "_domain",
        F.regexp_extract(F.url_decode(F.input_file_name()), rf"meta_([^/]*){re.escape(ending)}(?:/|$)", 1),
    )
    # One entry per requested category, a short literal map.
    spelled = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.select("v", F.try_element_at(spelled, F.col("_domain")).alias("category"))


def distinct_categories(names: DataFrame) -> DataFrame:
    """``(pos, category)`` of the first spelling of each name, blanks dropped.

    ``names`` holds ``pos`` and ``category``; names differing in case are one.
    """
    clean = names.select("pos", strip(F.col("category")).alias("category")).filter(
        F.col("category") != ""
    )
    return clean.groupBy(fold_case(F.col("category")).alias("_key")).agg(
        F.min("pos").alias("pos"), F.min_by("category", "pos").alias("category")
    ).drop("_key")


def resolve_categories(
    spark: SparkSession, categories: list[str] | None, category: str | None, default: str
) -> list[str]:
    """Categories of a request: the list, else the single one, else the default."""
    wanted = categories if categories is not None else [category or default]
    if not wanted:
        return []
    names = spark.createDataFrame(list(enumerate(wanted)), "pos int, category string")
    resolved = distinct_categories(names)
    return [row["category"] for row in resolved.orderBy("pos").collect()]


def category_counts(rows: DataFrame) -> DataFrame:
    """Rows per category, and in all under a NULL category."""
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("row_count"))
