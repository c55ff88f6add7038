"""Keyed upsert, column patches and lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.text import strip
from vitrine.operators.topk import top_k_per_key
from vitrine.session import row_count_up_to


# Column of staged rows that orders them as their source does.
SEQUENCE = "sequence"


def last_written(rows: DataFrame) -> list[Column] | None:
    """Order that puts the last row of the source first, where ``rows`` carry their place in it."""
    return [F.col(SEQUENCE).desc()] if SEQUENCE in rows.columns else None


def one_per_key(rows: DataFrame, key: str = "id", version: list[Column] | None = None) -> DataFrame:
    """One row of each key: the first by ``version``.

    Without ``version`` a key must have one row: which of several would win
    depended on where Spark has put them, so the job fails instead.
    """
    if version is not None:
        return top_k_per_key(rows, [key], version, 1, "_place").drop("_place")
    placed = top_k_per_key(rows, [key], [F.col(key)], 2, "_place")
    several = F.concat(F.lit("several rows and no version for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return placed.filter(F.when(F.col("_place") > 1, F.raise_error(several)).otherwise(F.lit(True))).drop("_place")


def upsert(
    target: DataFrame,
    rows: DataFrame,
    key: str = "id",
    version: list[Column] | None = None,
    mode: str = "upsert",
) -> DataFrame:
    """Table after writing ``rows``: the written row wins, other keys survive.

    One row of each key is written, as ``one_per_key`` has it.
    ``mode="replace"`` drops everything that was there before.
    """
    if mode not in ("upsert", "replace"):
        raise ValueError(f"unknown write mode {mode!r}")
    rows = one_per_key(rows, key, version)
    if mode == "replace":
        return rows
    kept = target.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def merge_into(rows: DataFrame, table: str, key: str = "id") -> None:
    """Upsert ``rows`` into a catalog table whose format supports MERGE.

    Formats with row-level writes rewrite only the files they touch; ``upsert``
    is the form for plain Parquet.
    """
    (
        rows.alias("fresh")
        .mergeInto(table, F.col(f"{table}.{key}") == F.col(f"fresh.{key}"))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )


def patch_columns(
    target: DataFrame, patch: DataFrame, key: str = "id", version: list[Column] | None = None
) -> DataFrame:
    """Set the columns of ``patch`` on the ids it names; leave all else alone.

    Of several patches of one id the first by ``version`` holds. Columns that
    ``target`` does not have, as those of a version, are not set.
    """
    patch = one_per_key(patch, key, version)
    columns = [c for c in patch.columns if c != key and c in target.columns]
    renamed = patch.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = target.join(renamed, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def skip_existing(incoming: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key is not in the table yet."""
    return incoming.join(indexed.select(key), key, "left_anti")


def clean_ids(ids: DataFrame, key: str = "id") -> DataFrame:
    """Trimmed non-blank ids, each once."""
    clean = ids.select(strip(F.col(key)).alias(key))
    return clean.filter(F.col(key) != "").distinct()


def fetch_by_ids(
    docs: DataFrame, ids: DataFrame, columns: list[str] | None = None, key: str = "id"
) -> DataFrame:
    """Stored row of each wanted id, with ``found`` false where there is none."""
    wanted = clean_ids(ids, key)
    columns = columns or [c for c in docs.columns if c != key]
    stored = docs.select(key, *columns, F.lit(True).alias("found"))
    if row_count_up_to(wanted, settings.BROADCAST_LOOKUP_ROWS) <= settings.BROADCAST_LOOKUP_ROWS:
        # A left join cannot broadcast its left side, so narrow the table first.
        stored = stored.join(F.broadcast(wanted), key, "left_semi")
    return wanted.join(stored, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row tables, without joining them."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
