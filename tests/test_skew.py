"""A third or more of all rows on one key: results stay whole and exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vitrine.functions.text import normalize_query
from vitrine.operators import blobs, drops, facets, history, pipeline_status, tables
from vitrine.operators.embedding import hashed_tokens_encoder
from vitrine.queries.registry import entries

N = 60_000


def hot(spark, key="hot", share=3):
    """Rows where every ``share``-th one has the same key."""
    return spark.range(N).withColumn(
        "k", F.when(F.col("id") % share == 0, key).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    )


def test_hot_user(spark):
    views = hot(spark).select(
        F.col("id").alias("event_id"),
        F.col("k").alias("user_id"),
        F.concat(F.lit("D"), F.col("id") % 1000).alias("doc_id"),
        F.col("id").alias("ts_ms"),
    )
    got = history.recent_views(views).filter("user_id = 'hot'").orderBy("place").collect()
    assert [r["event_id"] for r in got] == [N - 3 - 3 * n for n in range(12)]


def test_hot_facet_value(spark):
    counts = {r["value"]: r["doc_count"] for r in facets.facet_counts(hot(spark), ["k"]).collect()}
    assert counts["hot"] == N // 3 and sum(counts.values()) == N


def test_hot_document(spark):
    events = hot(spark).select(
        F.col("id").alias("event_id"),
        F.col("k").alias("doc_id"),
        F.lit("p").alias("pipeline_id"),
        F.when(F.col("id") == N - 3, "indexed").otherwise("pending").alias("stage"),
        F.lit(7).cast("long").alias("ts_ms"),
    )
    got = {r["stage"]: r["doc_count"] for r in pipeline_status.stage_counts(events).collect()}
    assert got["indexed"] == 1


def test_hot_upsert_time(spark):
    marks = spark.range(1, 301).select(
        F.concat(F.lit("d"), "id").alias("label"),
        (F.col("id") * 10).alias("watermark_ms"),
        F.lit(1).cast("long").alias("row_count"),
    )
    docs = spark.range(N).select(F.when(F.col("id") % 3 == 0, 1505).otherwise(F.col("id") % 3000).alias("upserted_at"))
    for limit in (1000, 0):
        found = drops.drop_membership(docs, marks, broadcast_limit=limit)
        assert found.count() == N
        wrong = found.filter(
            F.coalesce(F.col("label") != F.concat(F.lit("d"), F.ceil(F.col("upserted_at") / 10)), F.col("upserted_at") != 0)
        )
        assert wrong.isEmpty()


def test_hot_copies_of_a_blob(spark):
    contents = hot(spark).select(F.col("id").cast("string").alias("id"), F.encode("k", "UTF-8").alias("content"))
    stored = blobs.distinct_blobs(blobs.addressed(contents, "ns"))
    assert stored.count() == contents.select("content").distinct().count()


def test_hot_key_in_an_upsert(spark):
    target = spark.createDataFrame([("hot", -1), ("old", -1)], "id string, n long")
    rows = hot(spark).select(F.col("k").alias("id"), F.col("id").alias("n"))
    got = tables.upsert(target, rows, version=[F.col("n").desc()])
    found = {r["id"]: r["n"] for r in got.select("id", "n").collect()}
    assert found["hot"] == N - 3 and found["old"] == -1


def test_text_search_matches_brute_force(spark, data):
    """The encoded search over whole tables against plain numpy."""
    from vitrine.fixtures import view

    docs = view(spark, data, "products").select("id", "description").collect()
    asked = [
        r[0]
        for r in view(spark, data, "search_history")
        .select(normalize_query(F.col("raw_query")))
        .distinct()
        .collect()
    ]
    encode = hashed_tokens_encoder()()

    def unit(texts):
        m = encode(texts)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        return m.astype(np.float32).astype(np.float64)

    have, want = unit([d["description"] for d in docs]), unit(asked)
    have /= np.linalg.norm(have, axis=1, keepdims=True)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    dist = np.round(1 - have @ want.T, 6) + 0.0
    wanted = {}
    for column, query in enumerate(asked):
        order = sorted(range(len(docs)), key=lambda row: (dist[row, column], docs[row]["id"]))[:10]
        wanted[query] = [docs[row]["id"] for row in order]
    got: dict[str, list[str]] = {}
    found = entries()["text_search"].run(spark, data)
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    assert got == wanted
