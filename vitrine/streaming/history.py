"""Live view and search history per user with bounded state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine import settings
from vitrine.functions.text import collapse
from vitrine.streaming.runner import BATCH

STATE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
ENTRY = ["key", "item", "ts_ms", "event_id"]
OUTPUT = "user_id long, item string, ts_ms long, event_id long, place int"


class LatestDistinct(StatefulProcessor):
    """Keeps a user's newest ``limit`` distinct items.

    Rows bring ``key`` (what makes an item distinct), ``item`` (what is shown),
    ``ts_ms`` and ``event_id``. Only ``limit`` entries are held per user. That is
    enough for late rows as well: an item that fell out is older than all that
    stayed, and those only get newer.
    """

    def __init__(self, limit: int, ttl_ms: int | None) -> None:
        self.limit = limit
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState(
            "entries", "key string, item string, ts_ms long, event_id long", self.ttl_ms
        )

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.entries.get()]
        newest = pd.DataFrame(held, columns=ENTRY) if held else None
        for frame in rows:
            # One frame at a time, cut to the limit, however many rows a user has.
            newest = self._newest(frame[ENTRY] if newest is None else pd.concat([newest, frame[ENTRY]]))
        self.entries.put([tuple(e) for e in newest.astype(object).to_numpy().tolist()])
        yield newest.assign(user_id=key[0], place=range(1, len(newest) + 1))[
            ["user_id", "item", "ts_ms", "event_id", "place"]
        ]

    def _newest(self, found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values(["ts_ms", "event_id", "item"], ascending=False, kind="stable")
        return ordered.drop_duplicates("key").head(self.limit)

    def close(self) -> None:
        pass


def _live(rows: DataFrame, limit: int, ttl_ms: int | None) -> DataFrame:
    """Every batch emits the whole current list of each user it touched.

    Needs the RocksDB state store (``STATE_PROVIDER``).
    """
    # The Python process that declares the state does not see shipped packages.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.groupBy("user_id").transformWithStateInPandas(
        LatestDistinct(limit, ttl_ms), OUTPUT, "Update", "ProcessingTime" if ttl_ms else "None"
    )


def live_views(
    views: DataFrame, limit: int = settings.MAX_VIEWS, ttl_ms: int | None = None
) -> DataFrame:
    rows = views.filter(F.col("doc_id").isNotNull()).select(
        "user_id", F.col("doc_id").alias("key"), F.col("doc_id").alias("item"), "ts_ms", "event_id"
    )
    return _live(rows, limit, ttl_ms)


def live_searches(
    searches: DataFrame, limit: int = settings.MAX_RECENT_SEARCHES, ttl_ms: int | None = None
) -> DataFrame:
    shown = searches.withColumn("item", collapse(F.col("raw_query"))).filter(F.col("item").isNotNull())
    rows = shown.select(
        "user_id",
        F.lower("item").alias("key"),
        "item",
        F.col("timestamp_ms").alias("ts_ms"),
        "event_id",
    )
    return _live(rows, limit, ttl_ms)


def current_lists(updates: DataFrame) -> DataFrame:
    """The newest list of every user from the written batches."""
    last = updates.groupBy("user_id").agg(F.max(BATCH).alias("_last"))
    kept = updates.join(last, "user_id").filter(F.col(BATCH) == F.col("_last"))
    return kept.drop("_last", BATCH)

