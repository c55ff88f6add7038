from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vitrine.operators import blobs, embedding, facets, pipeline_status as ps, tables
from vitrine.operators.ordinals import with_ordinals, with_running_total
from vitrine.plans.backfill_job import backfill
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources import scans
from vitrine.sources.bucketed import BucketedTable

EVENT = "event_id long, doc_id string, pipeline_id string, stage string, ts_ms long"


def status(spark, *counts):
    table = spark.createDataFrame(list(counts), "pipeline_id string, stage string, doc_count long")
    wanted = spark.createDataFrame([("p",), ("q",)], "pipeline_id string")
    return ps.status_of(table, wanted)


def test_latest_stage_breaks_ties_by_event(spark, rows):
    events = spark.createDataFrame(
        [(1, "D", "p", "pending", 5), (2, "D", "p", "indexed", 9), (3, "D", "p", "failed", 9), (4, "D", "p", "pending", 7)],
        EVENT,
    )
    assert rows(ps.stage_counts(events)) == [("p", "failed", 1)]


def test_stability(spark):
    busy = status(spark, ("p", "pending", 1), ("p", "extracting", 1), ("q", "indexed", 3))
    gate = ps.stability(busy)
    assert {r["pipeline_id"]: r["stable"] for r in gate.collect()} == {"p": False, "q": True}
    assert [r["pipeline_id"] for r in ps.blockers(gate).collect()] == ["p"]
    assert ps.all_stable(gate).first()["stable"] is False
    one = status(spark, ("p", "extracting", 1), ("p", "failed", 1))
    assert ps.all_stable(ps.stability(one, 1, True)).first()["stable"] is True
    assert ps.all_stable(ps.stability(one, 1, False)).first()["stable"] is False
    assert ps.all_stable(ps.stability(one, 0, True)).first()["stable"] is False


def test_unknown_pipeline_is_a_zero_row(spark):
    got = {r["pipeline_id"]: tuple(r)[1:] for r in status(spark, ("p", "complete", 2)).collect()}
    assert got == {"p": (0, 0, 0, 0), "q": (0, 0, 0, 0)}


def test_status_encodings(spark):
    given = {
        "object": {"counts": {"pending": 1, "failed": 2.5, "x": "3"}},
        "list": {"stages": [{"stage": "a", "count": 1}, {"stage": "a", "count": 4}, {"stage": None, "count": 1}, 7]},
        "skip": {"stages": 5, "stage_counts": {"b": 2}},
        "flat": {"c": 3, "name": "n"},
        "empty": {"counts": {}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in given.items()], "pipeline_id string, status string")
    got = {}
    for r in ps.counts_from_status(df).collect():
        got.setdefault(r["pipeline_id"], {})[r["stage"]] = r["doc_count"]
    assert got == {"object": {"pending": 1}, "list": {"a": 4}, "skip": {"b": 2}, "flat": {"c": 3}}


def test_cursor(spark):
    marks = spark.createDataFrame([("a", 1, 5), ("b", 2, -3), ("c", 3, 7)], "label string, watermark_ms long, row_count long")
    assert ps.refresh_cursor(marks).first()[0] == 12
    assert ps.refresh_cursor(marks.limit(0)).first()[0] == 0


def test_throughput(spark, rows):
    events = spark.createDataFrame(
        [(n, "D", "p", "indexed" if n % 2 else "pending", n * 1000) for n in range(240)], EVENT
    )
    got = ps.index_throughput(events, 2).orderBy("window_end_ms")
    assert rows(got) == [("p", 120_000, 60, 30.0), ("p", 240_000, 60, 30.0)]


def test_facets(spark, rows):
    docs = spark.createDataFrame([("Audio", "x1"), ("Audio", "x2"), ("Cameras", "x3"), (None, "x4")], "category string, id string")
    got = facets.facet_snapshot(docs, ["category", "id"], max_distinct=3)
    assert sorted(rows(got)) == [("category", "Audio", 2), ("category", "Cameras", 1)]
    sizes = {r["field"]: (r["distinct_values"], r["skipped"]) for r in facets.field_sizes(docs, ["category", "id"], 3).collect()}
    assert sizes == {"category": (2, False), "id": (4, True)}


def test_metadata(spark):
    docs = spark.createDataFrame([(5,), (9,)], "upserted_at long")
    assert tuple(facets.table_metadata(docs).first()) == (2, 9, False)
    gate = ps.stability(status(spark, ("p", "indexed", 1)))
    assert tuple(facets.table_metadata(docs, gate).first()) == (2, 9, True)


# --- Ordinals ---


def test_ordinals_and_totals(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).alias("w")).repartition(13)
    got = {r["k"]: r["ordinal"] for r in with_ordinals(df, ["k"]).collect()}
    assert got == {k: k for k in range(1000)}
    totals = {r["k"]: r["running_total"] for r in with_running_total(df, ["k"], "w").collect()}
    assert totals == {k: 2 * (k + 1) for k in range(1000)}
    backwards = with_ordinals(df, [F.col("k").desc()])
    assert backwards.filter("k = 999").first()["ordinal"] == 0


def test_ordinals_of_nothing(spark):
    assert with_ordinals(spark.range(0), ["id"]).count() == 0


def test_scan_pages(spark):
    ids = spark.createDataFrame([(f"D{n}",) for n in range(4)], "id string")
    numbered = scans.numbered_ids(ids)
    got = scans.scan_page(numbered, 2, 1).collect()
    assert [(r["id"], r["next_offset"], r["total"]) for r in got] == [("D2", 3, 4)]
    assert scans.scan_page(numbered, -3, 2).count() == 2
    assert scans.scan_page(numbered, 3).count() == 1
    assert scans.scan_page(numbered, 9, 2).count() == 0


# --- Blobs ---

DOCS = [
    ("A1", "http://img/1", None),
    ("A2", "http://img/2", "blob://ns/" + "a" * 64),
    ("A3", " ", None),
]


def documents(spark):
    return spark.createDataFrame(DOCS, "id string, image_url string, image_blob string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_backfill_dry_run(spark):
    docs, stats = backfill(documents(spark), "ns", ids=ids(spark, "A1", "A2", "A3", "A4"))
    got = stats.first().asDict()
    assert got == {
        "inspected": 4, "fetched": 3, "already_backfilled": 1, "missing_image_url": 2,
        "attempted": 1, "patched": 0, "failed": 0, "bytes_stored": 0,
    }
    assert docs.filter("id = 'A1'").first()["image_blob"] is None


def test_backfill_applies(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    docs, stats = backfill(documents(spark), "ns", lambda url: b"picture", blob_folder=folder)
    wanted = "blob://ns/" + hashlib.sha256(b"picture").hexdigest()
    assert {r["id"]: r["image_blob"] for r in docs.collect()} == {"A1": wanted, "A2": DOCS[1][2], "A3": None}
    got = stats.first()
    assert (got["patched"], got["failed"], got["bytes_stored"]) == (1, 0, 7)
    assert [bytes(r["content"]) for r in blobs.stored_blobs(spark, folder).collect()] == [b"picture"]


def test_backfill_refuses_to_drop_bytes(spark):
    with pytest.raises(ValueError, match="blob_folder"):
        backfill(documents(spark), "ns", lambda url: b"picture")


@pytest.mark.parametrize("answer", [b"", OSError("gone")])
def test_backfill_failures(spark, tmp_path, answer):
    def fetch(url):
        if isinstance(answer, Exception):
            raise answer
        return answer

    docs, stats = backfill(documents(spark), "ns", fetch, blob_folder=str(tmp_path / "blobs"))
    got = stats.first()
    assert (got["attempted"], got["patched"], got["failed"], got["bytes_stored"]) == (1, 0, 1, 0)
    assert docs.filter("id = 'A1'").first()["image_blob"] is None


def test_backfill_resumes(spark):
    stats = backfill(documents(spark), "ns", offset=2, max_docs=1)[1].first()
    assert (stats["inspected"], stats["missing_image_url"]) == (1, 1)


def test_equal_contents_are_stored_once(spark):
    contents = spark.createDataFrame([("b", b"x"), ("a", b"x"), ("c", b"yy")], "id string, content binary")
    got = {r["id"]: r["size"] for r in blobs.distinct_blobs(blobs.addressed(contents, "ns")).collect()}
    assert got == {"a": 1, "c": 2}


def test_read_files(spark, tmp_path):
    (tmp_path / "one.jpg").write_bytes(b"abc")
    (tmp_path / "none.jpg").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"abc")
    read = scans.read_files(spark, str(tmp_path), "*.jpg", ids(spark, "one", "none", "gone", "one"))
    got = {r["id"]: (r["content"], r["error"]) for r in read.collect()}
    failure = (None, "empty or absent")
    assert got == {"one": (b"abc", None), "none": failure, "gone": failure}
    assert [r["id"] for r in scans.read_files(spark, str(tmp_path), "*.txt").collect()] == ["other"]


def refs(spark, *digests):
    rows = [(f"D{n}", None if d is None else f"blob://ns/{d * 64}") for n, d in enumerate(digests)]
    return spark.createDataFrame(rows, "id string, image_blob string")


def test_audit(spark):
    docs = refs(spark, "a", "a", "b", None, "z")
    stored = spark.createDataFrame([("a" * 64, 10), ("c" * 64, 99)], "sha string, size long")
    got = blobs.reference_audit(docs, stored).first().asDict()
    assert got == {
        "documents_scanned": 5, "refs_seen": 4, "invalid_refs": 1, "objects": 1, "missing": 1, "bytes": 10,
    }


def test_budget(spark):
    docs = refs(spark, "b", "a", "b", "c")
    stored = spark.createDataFrame([(d * 64, 10) for d in "abc"], "sha string, size long")
    prefix = blobs.budget_prefix(docs, stored, 20)
    assert {r["id"]: (r["running_total"], r["chosen"]) for r in prefix.collect()} == {
        "D0": (10, True), "D1": (20, True), "D3": (30, False),
    }
    assert tuple(blobs.budget_summary(prefix).first()) == (2, 20, True)
    assert tuple(blobs.budget_summary(blobs.budget_prefix(docs, stored, 30)).first()) == (3, 30, False)


def test_derive_upserts_what_a_function_returns(spark, rows):
    source = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "id string, n long")
    target = spark.createDataFrame([("a", 0), ("z", 9)], "id string, n long")

    def totals(df):
        return df.groupBy("id").agg(F.sum("n").alias("n"))

    got = embedding.derive(totals, [source], target)
    assert sorted(rows(got.select("id", "n"))) == [("a", 3), ("b", 5), ("z", 9)]
    assert rows(embedding.undiscovered(spark.createDataFrame([("a", None), ("b", 1)], "id string, m int"), "m")) == [("a", None)]


def test_checkpoint_folder_is_the_named_one(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_one_row_per_key(spark):
    """Repeated keys in rows and patches: the first by version holds, wherever Spark has put the rows."""
    target = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, n int, sequence int")
    rows = spark.createDataFrame([(k, 10 * n, n) for n in range(40) for k in "ac"], "id string, n int, sequence int")
    for dealt in (rows.repartition(5), rows.repartition(3, "n"), rows.coalesce(1)):
        last = tables.last_written(dealt)
        got = tables.upsert(target, dealt, version=last).select("id", "n")
        assert sorted(map(tuple, got.collect())) == [("a", 390), ("b", 1), ("c", 390)]
        got = tables.patch_columns(target, dealt, version=last).select("id", "n")
        assert sorted(map(tuple, got.collect())) == [("a", 390), ("b", 1)]


def test_repeated_keys_without_a_version_are_refused(spark):
    target = spark.createDataFrame([("a", 1)], "id string, n int")
    once = spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int")
    assert sorted(map(tuple, tables.upsert(target, once).collect())) == [("a", 2), ("b", 3)]
    with pytest.raises(Exception, match="several rows and no version for key b"):
        tables.upsert(target, once.union(once.filter("id = 'b'"))).collect()


def bucket_files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("bucket=*/*.parquet")}


def test_bucketed_table_touches_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=8)
    assert not table.exists() and table.beside(spark.createDataFrame([("a",)], "id string")) is None
    empty = spark.createDataFrame([], "id string, n int")
    assert table.upsert(empty) is None and table.patch(empty) is None
    assert table.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "id string, n int")) == 0
    before = bucket_files(tmp_path / "t")
    assert table.upsert(spark.createDataFrame([("k3", -3), ("k3", -4), ("new", 7)], "id string, n int"), version=[F.col("n")]) == 1
    assert table.patch(spark.createDataFrame([("k9", -9), ("absent", 1)], "id string, n int")) == 2
    after = bucket_files(tmp_path / "t")
    assert {p: after[p] for p in before} == before
    assert len({p.parent.name for p in after if "folder=1" in str(p)}) <= 2
    wanted = {f"k{i}": i for i in range(100)} | {"k3": -4, "new": 7, "k9": -9}
    assert {r["id"]: r["n"] for r in table.read().collect()} == wanted and table.read().count() == 101
    some = table.beside(spark.createDataFrame([("k9",)], "id string"))
    assert "k9" in {r["id"] for r in some.collect()} and some.count() < 60
    # Columns that come later are null in older buckets.
    table.upsert(spark.createDataFrame([("k5", 1, "x")], "id string, n int, extra string"))
    assert {r["id"] for r in table.read().filter("extra = 'x'").collect()} == {"k5"}
    with pytest.raises(ValueError, match="has 8 buckets"):
        BucketedTable(spark, str(tmp_path / "t"), buckets=4).read()


def test_write_that_dies_leaves_the_table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    broken = spark.createDataFrame([("a", 5), ("c", 6)], "id string, n int").withColumn(
        "n", F.when(F.col("id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("n"))
    )
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    # A folder without a manifest row is no part of the table, and the next write takes its place.
    (tmp_path / "t" / "data" / "folder=1" / "bucket=0").mkdir(parents=True)
    assert {r["id"]: r["n"] for r in table.read().collect()} == {"a": 1, "b": 2}
    assert table.upsert(spark.createDataFrame([("a", 9)], "id string, n int")) == 1
    assert {r["id"]: r["n"] for r in table.read().collect()} == {"a": 9, "b": 2}


def test_stored_bytes_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    contents = spark.createDataFrame(
        [("a", b"one"), ("b", b"one"), ("c", b"two"), ("d", None)], "id string, content binary"
    )
    for _ in range(2):
        held = blobs.store_blobs(blobs.addressed(contents, "ns"), folder)
        assert sorted(r["size"] for r in held.collect()) == [3, 3]
    assert spark.read.parquet(folder).count() == 2
    docs, _stats = backfill(documents(spark), "ns", lambda url: b"picture", blob_folder=folder)
    had = documents(spark).filter("coalesce(image_blob, '') like 'blob://%'").select("id")
    audit = blobs.reference_audit(docs.join(had, "id", "left_anti"), blobs.stored_blobs(spark, folder))
    assert audit.first()["missing"] == 0
