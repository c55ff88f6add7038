from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vitrine.operators import pipeline_status as ps
from vitrine.operators import products
from vitrine.sources.versioned import VersionedTable
from vitrine.streaming import attribution, history, ledger, refresh, runner, trending

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SEARCH = "event_id long, trace_id string, raw_query string, top_result_ids array<string>, ts timestamp"
CLICK = "event_id long, trace_id string, doc_id string, ts timestamp"


def hour(n: float) -> datetime:
    return START + timedelta(hours=n)


class Feed:
    """Parquet files of a folder, read one per micro-batch in the order written."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, *rows):
        import os
        import time

        df = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        part = f"{self.folder}/part={self.n}"
        df.write.parquet(part)
        stamp = time.time() - 1000 + self.n
        for name in os.listdir(part):
            os.utime(f"{part}/{name}", (stamp, stamp))
        self.n += 1
        return self

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/*")

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(f"{self.folder}/*")


def test_sliding_windows_with_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SEARCH)
    feed.add((1, "t", "Lamp", [], hour(0.5)), (2, "t", " lamp", [], hour(3)))
    feed.add((3, "t", "lamp", [], hour(26)), (4, "t", "desk", [], hour(26)))
    # Out of order but within a day of the newest row.
    feed.add((5, "t", "lamp", [], hour(4)))
    feed.add((6, "t", "x", [], hour(120)))
    # The watermark a batch moves decides on lateness from the next but one on.
    feed.add((8, "t", "x", [], hour(120)))
    # A row for windows that are long closed.
    feed.add((7, "t", "lamp", [], hour(5)))
    got = runner.run_to_end(trending.sliding_counts(feed.stream())).drop("batch_id")
    in_time = feed.batch().filter("event_id <> 7")
    wanted = trending.sliding_counts(in_time).filter(F.col("window_end") <= F.lit(hour(96)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    top = trending.top_per_window(got, min_count=2)
    at = {r["window_end"].replace(tzinfo=timezone.utc): r["count"] for r in top.collect()}
    assert at[hour(5)] == 3 and at[hour(24)] == 3


def test_attribution_in_either_order(spark, tmp_path):
    searches = Feed(spark, tmp_path / "s", SEARCH)
    clicks = Feed(spark, tmp_path / "c", CLICK)
    clicks.add((10, "t1", "B", hour(1)), (11, "", "A", hour(1)))
    clicks.add((12, "t1", "A", hour(2)), (13, "t1", "Z", hour(2)), (14, "t1", "A", hour(40)))
    searches.add((1, "t2", "desk", ["A"], hour(1)))
    searches.add((2, "t1", "Lamp", ["A", "B", "A"], hour(3)), (3, "t1", "", ["A"], hour(3)))
    got = runner.run_to_end(trending.attributed_clicks(searches.stream(), clicks.stream()))
    seen = sorted((r["search_id"], r["click_id"], r["doc_id"], r["rank"]) for r in got.collect())
    assert seen == [(2, 10, "B", 1), (2, 12, "A", 2)]


def test_counted_attribution_over_batches(spark, tmp_path):
    searches = Feed(spark, tmp_path / "s", SEARCH)
    clicks = Feed(spark, tmp_path / "c", CLICK)
    clicks.add((10, "t1", "B", hour(1)), (11, "", "A", hour(1)), (20, None, "A", hour(1)), (21, "t1", None, hour(1)))
    clicks.add((12, "t1", "A", hour(2)), (13, "t1", "Z", hour(2)), (14, "t1", "A", hour(40)))
    # Same query, other list: the document has two places.
    searches.add((1, "t2", "desk", ["A"], hour(1)), (4, "t1", "lamp", ["B", "A"], hour(4)), (5, "t1", "lamp", None, hour(4)))
    searches.add((2, "t1", "Lamp", ["A", "B", "A"], hour(3)), (3, "t1", "", ["A"], hour(3)))
    added = runner.run_to_end(attribution.counted_attribution(searches.stream(), clicks.stream()))
    rows = attribution.attribution_counts(added).collect()
    seen = sorted((r["doc_id"], r["query"], r["rank"], r["searches"], r["meetings"]) for r in rows)
    assert seen == [("A", "lamp", 1, 1, 1), ("A", "lamp", 2, 1, 1), ("B", "lamp", 0, 1, 1), ("B", "lamp", 1, 1, 1)]


def test_counted_attribution_of_a_repeating_trace(spark, tmp_path):
    """A thousand searches and clicks of one trace: one row with their count."""
    searches = Feed(spark, tmp_path / "s", SEARCH)
    clicks = Feed(spark, tmp_path / "c", CLICK)
    for part in range(2):
        here = range(500 * part, 500 * part + 500)
        searches.add(*[(n, "t", "lamp", ["A"], hour(n / 100)) for n in here])
        clicks.add(*[(10_000 + n, "t", "A", hour(n / 100)) for n in here])
    added = runner.run_to_end(attribution.counted_attribution(searches.stream(), clicks.stream()))
    assert added.count() <= 2
    (row,) = attribution.attribution_counts(added).collect()
    assert (row["searches"], row["meetings"]) == (1000, 1_000_000)


def test_counted_attribution_lets_old_minutes_go(spark, tmp_path):
    """State of a trace that went quiet is dropped once the watermark has passed its reach."""
    searches = Feed(spark, tmp_path / "s", SEARCH)
    clicks = Feed(spark, tmp_path / "c", CLICK)
    for at in (0, 100, 200, 300):
        searches.add((at, f"t{at}", "lamp", ["A"], hour(at)))
        clicks.add((1000 + at, f"t{at}", "A", hour(at + 1)))
    folder = str(tmp_path / "run")
    added = runner.run_to_end(
        attribution.counted_attribution(searches.stream(), clicks.stream()), folder=folder
    )
    assert {r["trace_id"]: r["meetings"] for r in attribution.attribution_counts(added).collect()} == {
        f"t{at}": 1 for at in (0, 100, 200, 300)
    }
    state = (
        spark.read.format("statestore").option("stateVarName", "slots").load(f"{folder}/progress")
    )
    assert {r["key"]["trace_id"] for r in state.select("key").distinct().collect()} <= {"t200", "t300"}


def test_counted_attribution_keeps_one_state_a_trace(spark, tmp_path):
    """A search that lists ten documents opened ten states, each with calls and a timer of its own."""
    searches = Feed(spark, tmp_path / "s", SEARCH)
    clicks = Feed(spark, tmp_path / "c", CLICK)
    searches.add(*[(n, f"t{n}", "lamp", [f"D{i}" for i in range(10)], hour(n)) for n in range(3)])
    clicks.add(*[(10 + n, f"t{n}", f"D{i}", hour(n)) for n in range(3) for i in (2, 7)])
    folder = str(tmp_path / "run")
    added = runner.run_to_end(
        attribution.counted_attribution(searches.stream(), clicks.stream()), folder=folder
    )
    rows = attribution.attribution_counts(added).collect()
    assert {(r["trace_id"], r["doc_id"], r["rank"], r["searches"], r["meetings"]) for r in rows} == {
        (f"t{n}", f"D{i}", i, 1, 1) for n in range(3) for i in (2, 7)
    }
    state = spark.read.format("statestore").option("stateVarName", "slots").load(f"{folder}/progress")
    assert state.select("key").distinct().count() == 3


def test_meetings_equal_pairs():
    import random
    from collections import Counter

    pick = random.Random(4)
    for _ in range(50):
        left = Counter(pick.randrange(40) for _ in range(30))
        right = Counter(pick.randrange(40) for _ in range(30))
        reach = pick.randrange(12)
        pairs = sum(n * m for a, n in left.items() for b, m in right.items() if abs(a - b) <= reach)
        assert attribution.meetings(left, right, reach) == pairs


def test_stage_ledger(spark, tmp_path):
    schema = "event_id long, doc_id string, pipeline_id string, stage string, ts_ms long"
    feed = Feed(spark, tmp_path / "in", schema)
    feed.add((1, "D1", "p", "pending", 5), (2, "D2", "p", "pending", 5))
    feed.add((4, "D1", "p", "indexed", 9))
    feed.add((3, "D1", "p", "embedding", 7))
    updates = runner.run_to_end(ledger.live_stages(feed.stream()), "update")
    got = {r["doc_id"]: r["stage"] for r in ledger.settled_stages(updates).collect()}
    assert got == {"D1": "indexed", "D2": "pending"}
    assert got == {r["doc_id"]: r["stage"] for r in ps.latest_stages(feed.batch()).collect()}


def test_live_history(spark, tmp_path):
    schema = "event_id long, user_id long, doc_id string, ts_ms long"
    feed = Feed(spark, tmp_path / "in", schema)
    feed.add(*[(n, 1, f"D{n}", n) for n in range(20)])
    feed.add((30, 1, "D3", 50), (31, 1, "D1", 2), (32, 2, "D9", 1))
    feed.add((33, 1, "D19", 60))
    updates = runner.run_to_end(history.live_views(feed.stream(), limit=4), "update")
    got = history.current_lists(updates).orderBy("user_id", "place").collect()
    assert [(r["user_id"], r["item"]) for r in got] == [(1, "D19"), (1, "D3"), (1, "D18"), (1, "D17"), (2, "D9")]


CAMERA = {"title": "Camera", "images": "http://img", "average_rating": 4.5}


def catalog_rows(spark, *names):
    lines = [(i, "Cameras", json.dumps({**CAMERA, "parent_asin": n})) for i, n in enumerate(names)]
    rows = spark.createDataFrame(lines, "n int, category string, j string")
    return products.normalize_products(rows.select("n", "category", F.parse_json("j").alias("v")), keep=["n"])


def tables(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "docs")), VersionedTable(spark, str(tmp_path / "marks"))


def test_refresh_runs(spark, tmp_path):
    docs, marks = tables(spark, tmp_path)
    valid = catalog_rows(spark, "A1", "A2", "A3", "A4", "A5")
    assert refresh.refresh_once(valid, ["n"], docs, marks, "catalog-1", 10, 2) == 2
    # The same label again changes nothing.
    assert refresh.refresh_once(valid, ["n"], docs, marks, "catalog-1", 11, 2) is None
    # A3 came in by another way and is skipped, but the cursor moves past it.
    docs.upsert(spark.createDataFrame([("A3", 5)], "id string, upserted_at long"))
    assert refresh.refresh_once(valid, ["n"], docs, marks, "catalog-2", 20, 2) == 1
    assert refresh.refresh_once(valid, ["n"], docs, marks, "catalog-3", 30, 2) == 1
    got = {r["id"]: r["upserted_at"] for r in docs.read().collect()}
    assert got == {"A1": 10, "A2": 10, "A3": 5, "A4": 20, "A5": 30}
    held = {r["label"]: (r["watermark_ms"], r["row_count"]) for r in marks.read().collect()}
    assert held == {"catalog-1": (10, 2), "catalog-2": (20, 2), "catalog-3": (30, 1)}


def test_checkpoint_waits_for_rest(spark, tmp_path):
    _, marks = tables(spark, tmp_path)
    gate = spark.createDataFrame([("p", True), ("q", False)], "pipeline_id string, stable boolean")
    assert refresh.activate_checkpoint(marks, "catalog-1", 5, 1, gate) is False
    assert not marks.exists()
    assert refresh.activate_checkpoint(marks, "catalog-1", 5, 1, gate.filter("stable")) is True
    assert refresh.activate_checkpoint(marks, "catalog-1", 9, 9) is False


@pytest.mark.parametrize("restart", [False, True])
def test_refresh_stream(spark, tmp_path, restart):
    docs, marks = tables(spark, tmp_path)
    source = tmp_path / "raw"
    source.mkdir()

    def write(name, *asins):
        lines = [json.dumps({**CAMERA, "parent_asin": a}) for a in asins]
        (source / name).write_text("\n\n".join(lines) + "\n")

    def drain(progress):
        rows = refresh.catalog_stream(spark, str(source), 1).withColumn("category", F.lit("Cameras"))
        refresh.run_refresh(
            rows, docs, marks, str(tmp_path / progress), lambda b: f"run-{b}", lambda b: 100 * (b + 1)
        )

    write("1.jsonl", "A1", "A2")
    drain("progress")
    write("2.jsonl", "A2", "A3")
    # A lost progress folder replays the first file under its old label.
    drain("other" if restart else "progress")
    got = {r["id"] for r in docs.read().collect()}
    assert got == {"A1", "A2", "A3"}
    assert {r["label"] for r in marks.read().collect()} == {"run-0", "run-1"}


def test_derived_rows_follow_writes(spark, tmp_path):
    from vitrine.streaming.derived import derive_on_write

    feed = Feed(spark, tmp_path / "in", "id string, title string")
    feed.add(("a", "x"), ("b", "yy"))
    feed.add(("b", "yyy"))
    target = VersionedTable(spark, str(tmp_path / "derived"))

    def lengths(batch):
        return batch.select("id", F.length("title").alias("n"))

    derive_on_write(feed.stream(), lengths, target, str(tmp_path / "progress"))
    assert {r["id"]: r["n"] for r in target.read().collect()} == {"a": 1, "b": 3}
    feed.add(("c", "z"))
    derive_on_write(feed.stream(), lengths, target, str(tmp_path / "progress"))
    assert {r["id"]: r["n"] for r in target.read().collect()} == {"a": 1, "b": 3, "c": 1}


def test_current_trending(spark, tmp_path):
    """Counts of a slot are replaced by later batches, and the window ends with the newest."""
    feed = Feed(spark, tmp_path / "in", SEARCH)
    feed.add((1, "t", "lamp", [], hour(1)), (2, "t", "desk", [], hour(26)))
    feed.add((3, "t", "Lamp", [], hour(1)), (4, "t", "desk", [], hour(26)), (5, "t", " ", [], hour(90)))
    feed.add((6, "t", "lamp", [], hour(20)))
    updates = runner.run_to_end(trending.slot_counts(feed.stream()), "update")
    got = {r["query"]: r["count"] for r in trending.current_counts(updates).collect()}
    assert got == {"desk": 2, "lamp": 1}
    nothing = trending.current_counts(updates.limit(0)).collect()
    assert nothing == []


def test_refused_runs_belong_to_the_next_checkpoint(spark, tmp_path):
    """Rows of a run that the gate refuses are counted by the one it lets through."""
    docs, marks = tables(spark, tmp_path)
    source = tmp_path / "files"
    source.mkdir()
    for i in range(3):
        line = json.dumps({**CAMERA, "parent_asin": f"A{i}"})
        (source / f"{i}.jsonl").write_text(line + "\n")
    calls = []

    def gate():
        calls.append(0)
        return spark.createDataFrame([("p", len(calls) > 1)], "pipeline_id string, stable boolean")

    rows = refresh.catalog_stream(spark, str(source), per_batch=1).withColumn("category", F.lit("Cameras"))
    refresh.run_refresh(
        rows, docs, marks, str(tmp_path / "progress"), lambda b: f"run-{b}", lambda b: 1000 * (b + 1), gate
    )
    assert sorted(map(tuple, marks.read().collect())) == [("run-1", 2000, 2), ("run-2", 3000, 1)]
