from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vitrine.functions import gain
from vitrine.functions.text import normalize_query
from vitrine.operators import trending
from vitrine.plans.trending_job import trending_tick, write_tick
from vitrine.sources import events
from vitrine.sources.versioned import VersionedTable

SEARCH = "event_id long, trace_id string, raw_query string, top_result_ids array<string>, timestamp_ms long"
CLICK = "trace_id string, doc_id string, timestamp_ms long"


def searches(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SEARCH)


def clicks(spark, *rows):
    return spark.createDataFrame(list(rows), CLICK)


@pytest.mark.parametrize(
    "raw, key",
    [
        ("  Wireless   Headphones ", "wireless headphones"),
        ("Straße \tNORD", "strasse nord"),
        ("   ", None),
        ("", None),
        ("x" * 160, "x" * 160),
        ("x" * 161, None),
    ],
)
def test_normalize_query(spark, raw, key):
    df = spark.createDataFrame([(raw,)], "q string")
    assert df.select(normalize_query(F.col("q"))).first()[0] == key


@pytest.mark.parametrize(
    "ranks, wanted",
    [
        ([], 0.0),
        ([0], 1.0),
        ([0, 1, 2], 1.0),
        ([1], 1 / math.log2(3)),
        ([-1, 0], 1.0),
        ([0, 0], 2 / (1 + 1 / math.log2(3))),
    ],
)
def test_ndcg(spark, ranks, wanted):
    df = spark.createDataFrame([(ranks,)], "r array<int>")
    assert df.select(gain.ndcg(F.col("r"))).first()[0] == pytest.approx(wanted)


@pytest.mark.parametrize("n", [-1, 0, 1, 7, 999, 1000, 1001, 5000, 200_000])
def test_idcg_long_sums(spark, n):
    df = spark.createDataFrame([(n,)], "n long")
    exact = math.fsum(1 / math.log2(i + 2) for i in range(n))
    assert df.select(gain.idcg(F.col("n"))).first()[0] == pytest.approx(exact, rel=1e-9)


def test_floor_and_top_n(spark, rows):
    found = searches(
        spark,
        ("t1", "Lamp", ["L1"], 1),
        ("t2", " lamp ", ["L2"], 2),
        ("t3", "rare", ["R1"], 3),
        ("t4", "desk", ["D1"], 4),
        ("t5", "desk", ["D1"], 5),
        ("t6", "desk", ["D2"], 6),
    )
    ranked = trending.trending(found).select("query", "count", "score", "ndcg")
    assert rows(ranked) == [("desk", 3, 3.0, 0.0), ("lamp", 2, 2.0, 0.0)]
    assert rows(trending.trending(found, top_n=1).select("query")) == [("desk",)]
    assert rows(trending.trending(found, top_n=0)) == []


def test_quality_reorders(spark, rows):
    found = searches(
        spark,
        ("t1", "lamp", ["L1", "L2", "L3"], 1),
        ("t2", "lamp", ["L1", "L2", "L3"], 2),
        ("t3", "headphones", ["H1", "H2"], 3),
        ("t4", "headphones", ["H1", "H2"], 4),
    )
    clicked = clicks(spark, ("t3", "H1", 12), ("t4", "H1", 13), ("t3", "absent", 14), ("", "L1", 1))
    ranked = trending.trending(found, clicked, quality_weight=1.0)
    assert [r[0] for r in rows(ranked)] == ["headphones", "lamp"]
    assert rows(ranked.select("score")) == [(4.0,), (2.0,)]
    plain = trending.trending(found, clicked)
    assert rows(plain.select("query", "score")) == [("headphones", 2.0), ("lamp", 2.0)]


def test_last_position_and_repeated_clicks(spark, rows):
    found = searches(spark, ("t", "a", ["X", "Y", "X"], 1), ("t", "a", ["Y"], 2))
    clicked = clicks(spark, ("t", "X", 3), ("t", "Y", 4), ("t", "Y", 5))
    ranked = trending.ranked_clicks(trending.search_groups(trending.keyed_searches(found)), clicked)
    seen = sorted(rows(ranked.select("group_id", "doc_id", "rank", "clicks")))
    assert seen == [(0, "X", 2, 1), (0, "Y", 1, 2), (1, "Y", 0, 2)]
    first = 1 / math.log2(4) + 2 / math.log2(3)
    ideal3 = 1 + 1 / math.log2(3) + 0.5
    second = 2 / (1 + 1 / math.log2(3))
    mean = (first / ideal3 + second) / 2
    got = trending.trending(found, clicked, quality_weight=2.0).first()
    assert got["ndcg"] == pytest.approx(mean)
    assert got["score"] == pytest.approx(2 * (1 + 2 * mean))


def test_samples_keep_first_seen_order(spark):
    found = searches(
        spark,
        ("t1", "q", ["C", "A"], 20),
        ("t2", "q", ["B", "A", "C"], 10),
        ("t3", "q", ["D", "E", "F", "G"], 30),
    )
    got = trending.trending(found).first()["sample_top_ids"]
    assert got == ["B", "A", "C", "D", "E"]


def test_query_without_results_keeps_its_row(spark, rows):
    found = searches(spark, ("t1", "q", [], 1), ("t2", "q", [], 2))
    for top_n in (5, None):
        assert rows(trending.trending(found, top_n=top_n)) == [("q", 2, 2.0, 0.0, [])]


def test_samples_match_list_form(spark, data):
    """The ranked form equals flattening every list of a query in order."""
    from vitrine.queries.trending import searches as logged

    keyed = trending.keyed_searches(logged(spark, data))
    lists = keyed.groupBy("query").agg(
        F.slice(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.array_sort(
                            F.collect_list(F.struct("timestamp_ms", "event_id", "top_result_ids"))
                        ),
                        lambda s: s["top_result_ids"],
                    )
                )
            ),
            1,
            5,
        ).alias("sample")
    )
    wanted = {r["query"]: r["sample"] for r in lists.collect()}
    groups = trending.search_groups(keyed)
    assert {r["query"]: r["sample_top_ids"] for r in trending.sample_ids(groups).collect()} == wanted


def test_one_hot_trace(spark):
    """A trace with very many searches and clicks stays linear and exact."""
    found = spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.lit("bot").alias("trace_id"),
        F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("raw_query"),
        F.array(F.lit("A"), F.lit("B"), F.lit("A")).alias("top_result_ids"),
        F.col("id").alias("timestamp_ms"),
    )
    clicked = spark.range(20_000).select(
        F.lit("bot").alias("trace_id"),
        F.when(F.col("id") % 4 == 0, "A").otherwise("Z").alias("doc_id"),
        F.col("id").alias("timestamp_ms"),
    )
    ranked = trending.ranked_clicks(trending.search_groups(trending.keyed_searches(found)), clicked)
    assert ranked.count() == 3
    got = trending.trending(found, clicked, quality_weight=1.0).first()
    ideal = math.fsum(1 / math.log2(i + 2) for i in range(5000))
    assert got["ndcg"] == pytest.approx(5000 / 2 / ideal, rel=1e-8)


def test_event_sources(spark, rows):
    history = spark.createDataFrame(
        [
            (1, "t1", "lamp", None, 5_000, ["page:first"]),
            (2, None, "lamp", ["L"], 6_000, ["page:first", "x"]),
            (3, "t3", None, ["L"], 6_000, ["page:first"]),
            (4, "t4", "lamp", ["L"], 6_000, ["page:next"]),
            (5, "t5", "lamp", ["L"], 99_000, ["page:first"]),
        ],
        SEARCH + ", tags array<string>",
    )
    found = events.read_searches(history, 5_000, 10_000)
    assert sorted(rows(found)) == [(1, "t1", "lamp", [], 5_000), (2, "", "lamp", ["L"], 6_000)]
    clicked = clicks(spark, ("t1", "A", 5_500), ("t1", None, 5_500), ("", "B", 5_500), ("t9", "C", 5_500))
    assert rows(events.read_clicks(clicked, found).select("doc_id")) == [("A",)]


def test_event_time(spark):
    df = spark.createDataFrame(
        [(5, None), (None, 1_999_999), (None, None), (7, 9_000_000)], "ms long, ns long"
    )
    got = [r[0] for r in df.select(events.event_time_ms(F.col("ms"), F.col("ns"))).collect()]
    assert got == [5, 1, 0, 7]


def test_tick_writes_and_keeps_old_rows(spark, rows, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "trending"))
    history = searches(
        spark, ("t1", "Lamp", ["L1"], 1_000), ("t2", " lamp ", ["L1"], 2_000)
    ).withColumn("tags", F.array(F.lit("page:first")))
    later = searches(
        spark, ("t1", "desk", ["D1"], 90_000_000), ("t2", "desk", ["D1"], 90_000_001)
    ).withColumn("tags", F.array(F.lit("page:first")))
    none = clicks(spark)
    assert write_tick(table, trending_tick(history, none, 5_000, "shop", "reduce")) == 0
    assert write_tick(table, trending_tick(history, none, 500_000_000, "shop", "reduce")) is None
    assert write_tick(table, trending_tick(later, none, 90_002_000, "shop", "reduce")) == 1
    kept = trending.read_trending(table.read())
    assert [r[0] for r in rows(kept)] == ["desk", "lamp"]
    stamped = {r["query"]: (r["as_of"], r["_derived_from"], r["_derived_by"]) for r in table.read().collect()}
    assert stamped == {"lamp": (5_000, "shop", "reduce"), "desk": (90_002_000, "shop", "reduce")}
    with pytest.raises(ValueError):
        trending.read_trending(table.read(), 51)
