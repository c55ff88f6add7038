"""Per-key top-k as a window, kept in a shape Catalyst prunes map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of every key; ``rank`` counts from 1.

    Written as ``row_number() <= k`` so that Spark plans a group limit before
    the shuffle: each map task sends at most ``k`` rows per key, hot or not.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place)).filter(F.col(rank) <= k)
