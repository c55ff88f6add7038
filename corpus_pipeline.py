"""A corpus pipeline of five stages over the documents table.

Each stage reads what its predecessor kept and all but the last return the
columns of documents. Quality rules drop documents and take their hosts' boilerplate lines out of the
others, line deduplication takes repeated lines out of texts, near-deduplication keeps one document of a group,
decontamination drops documents that share a window with the benchmark, and the
mix returns each taken document with the number of its copies.

Defined results: a null text has no words, so the quality rules drop it, as they
do empty ones; repeated rows and exact copies come down to one row in
near-deduplication; an empty table gives no rows; further columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.cube import mixed_documents
from vitrine.llm.frames import table
from vitrine.llm.fuzzy_lines import dedupe_lines
from vitrine.llm.golay import keep_one_of_each
from vitrine.llm.quality import good_documents
from vitrine.llm.winnowing import drop_contaminated
from vitrine.session import settle, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def counted(changed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, with ``n_chars`` following a text that lost lines."""
    n_chars = F.when(F.col("_gone").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Good documents without the boilerplate lines of their hosts."""
    ship_package(spark)
    return counted(good_documents(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without repeated lines."""
    ship_package(spark)
    return counted(dedupe_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group within four fingerprint bits; null and wordless texts are one group."""
    ship_package(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of the benchmark; null and wordless texts have none and stay."""
    return drop_contaminated(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Taken documents with ``copies``, their size and their source's size and target."""
    ship_package(spark)
    return mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

# Similarity groups, fuzzy lines and sampling have no SQL form; a brute-force version tests the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
