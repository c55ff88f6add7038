"""Counted click attribution on streams, one state per trace.

A stream-stream join writes a row for every search and click that meet, so a
trace that repeats both a thousand times writes a million rows. Here the two
streams are folded into counts per minute and each batch writes, for a listed
place, how many meetings it added. Counts are summed by ``attribution_counts``.

Opening a state, its timer and its calls cost far more than the few rows of a
document, so the documents of a trace share one.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.streaming.trending import LATENESS, listed_documents

SLOT_MS = 60_000
ADDED = "trace_id string, doc_id string, query string, rank int, searches long, meetings long"
Added = Row(*(column.split()[0] for column in ADDED.split(", ")))


def meetings(searches: Counter, clicks: Counter, reach: int) -> int:
    """Pairs of a search and a click at most ``reach`` slots apart."""
    ordered = sorted(clicks)
    total = held = low = high = 0
    for slot in sorted(searches):
        while high < len(ordered) and ordered[high] <= slot + reach:
            held += clicks[ordered[high]]
            high += 1
        while low < high and ordered[low] < slot - reach:
            held -= clicks[ordered[low]]
            low += 1
        total += searches[slot] * held
    return total


# A click has no query; its place is this one.
CLICKED = (None, -1)
# Counts per minute by place and document.
Held = dict[str, dict[tuple[str | None, int], Counter]]


class CountedAttribution(StatefulProcessor):
    """Counts per minute of the listings and clicks of a trace's documents.

    Minutes that no row can meet any more are dropped by a timer, so a document
    holds at most the minutes of the reach and the lateness, however often it
    repeats.
    """

    def __init__(self, reach: int) -> None:
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getListState("slots", "doc_id string, query string, rank int, slot long, n long")

    def _held(self) -> Held:
        held: Held = {}
        for doc_id, query, rank, slot, n in self.slots.get():
            held.setdefault(doc_id, {}).setdefault((query, rank), Counter())[slot] = n
        return held

    def _keep(self, held: Held) -> None:
        entries = [
            (doc_id, *place, slot, n)
            for doc_id, places in held.items()
            for place, slots in places.items()
            for slot, n in slots.items()
        ]
        if not entries:
            self.slots.clear()
            return
        self.slots.put(entries)
        oldest = min(entry[3] for entry in entries)
        self.handle.registerTimer((oldest + self.reach + 1) * SLOT_MS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old, new = self._held(), {}
        for row in rows:
            place = (row["query"], row["rank"])
            new.setdefault(row["doc_id"], {}).setdefault(place, Counter())[row["slot"]] += 1
        for doc_id, places in new.items():
            held = old.setdefault(doc_id, {})
            new_clicks = places.get(CLICKED, Counter())
            clicks = held.get(CLICKED, Counter()) + new_clicks
            for place in sorted((held.keys() | places.keys()) - {CLICKED}):
                before, now = held.get(place, Counter()), places.get(place, Counter())
                met = meetings(now, clicks, self.reach) if clicks else 0
                met += meetings(before, new_clicks, self.reach) if new_clicks else 0
                if now or met:
                    yield Added(key[0], doc_id, *place, now.total(), met)
            for place, slots in places.items():
                held.setdefault(place, Counter()).update(slots)
        self._keep(old)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first = timerValues.getCurrentWatermarkInMs() // SLOT_MS - self.reach
        held: Held = {}
        for doc_id, places in self._held().items():
            for place, slots in places.items():
                if left := {slot: n for slot, n in slots.items() if slot >= first}:
                    held.setdefault(doc_id, {})[place] = Counter(left)
        self._keep(held)
        return iter(())

    def close(self) -> None:
        pass


def counted_attribution(
    searches: DataFrame, clicks: DataFrame, lateness: str = LATENESS, reach_minutes: int = 24 * 60
) -> DataFrame:
    """What every batch adds: ``(trace_id, doc_id, query, rank, searches, meetings)``.

    Inputs are those of ``attributed_clicks``. Rows without a trace, a time, a
    document or (searches) a usable query are left out; a document listed twice
    in one search counts at its last place. Times are compared by the minute:
    a search and a click meet if their minutes are at most ``reach_minutes``
    apart. Needs the RocksDB state store.
    """
    slot = F.floor(F.unix_millis("ts") / SLOT_MS).alias("slot")
    listed = listed_documents(searches, lateness)
    shown = listed.filter(F.col("doc_id").isNotNull() & F.col("ts").isNotNull())
    clicked = clicks.filter(
        (F.coalesce("trace_id", F.lit("")) != "") & F.col("doc_id").isNotNull() & F.col("ts").isNotNull()
    ).withWatermark("ts", lateness)
    rows = shown.select("ts", "trace_id", "doc_id", "query", F.col("rank").cast("int").alias("rank"), slot).unionByName(
        clicked.select(
            "ts", "trace_id", "doc_id", F.lit(None).cast("string").alias("query"), F.lit(-1).alias("rank"), slot
        )
    )
    # The Python process that declares the state does not see shipped packages.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.groupBy("trace_id").transformWithState(
        CountedAttribution(reach_minutes), ADDED, "Append", "EventTime"
    )


def attribution_counts(added: DataFrame) -> DataFrame:
    """Sums of the written batches, places with a meeting only: one row a place."""
    return (
        added.groupBy("trace_id", "doc_id", "query", "rank")
        .agg(F.sum("searches").alias("searches"), F.sum("meetings").alias("meetings"))
        .filter("meetings > 0")
    )
