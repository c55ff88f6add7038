"""Bands of blocks: each row is copied a few times, and rough scores lose no answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.operators import blockwise, lexical, neighbours
from vitrine.operators import vector_search as vs


def stored(spark, rows, size=8):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(
        [(f"D{n}", [float(x) for x in rng.normal(size=size)]) for n in range(rows)], "id string, vector array<double>"
    )


def every(docs):
    return docs.select(F.col("id").alias("request_id"), "vector")


def counted(scorer, met):
    """The scorer, counting how often a group of requests is prepared."""

    class Counted(type(scorer)):
        def pack(self, requests):
            met.add(1)
            return super().pack(requests)

    scorer.__class__ = Counted
    return scorer


def test_small_blocks_meet_in_few_bands(spark):
    """Forty blocks of either side: each row went out forty times, to 1,600 groups."""
    docs, met = stored(spark, 400), spark.sparkContext.accumulator(0)
    found = blockwise.score_top_k(
        docs, every(docs), counted(vs.CosineScorer(), met), 3, broadcast_limit=0, block_docs=10, block_requests=10
    )
    assert found.count() == 1200
    assert 0 < met.value <= 32


def test_requests_are_worked_out_once(spark):
    """The requests of a second page are the outcome of the first search."""
    docs, met = stored(spark, 50), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        met.add(1)
        return name

    requests = every(docs).withColumn("request_id", seen.asNondeterministic()("request_id"))
    found = vs.vector_top_k(docs, requests, 3, broadcast_limit=10, block_docs=16, block_requests=16)
    assert found.count() == 150
    assert met.value == 50


def test_similar_items_meet_in_few_bands(spark):
    met = spark.sparkContext.accumulator(0)
    pool = spark.range(300).select(
        F.concat(F.lit("D"), "id").alias("id"),
        F.lit("a lamp").alias("title"),
        F.lit("for a desk").alias("description"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("category"),
        (F.col("id") % 50).cast("double").alias("price"),
    )
    seeds = pool.select(F.col("id").alias("request_id"), F.col("id").alias("seed_id"))
    before = lexical.SimilarScorer
    lexical.SimilarScorer = lambda: counted(before(), met)
    try:
        found = lexical.similar_items(pool, seeds, 4, broadcast_limit=0, block_docs=10, block_requests=10)
        assert found.count() == 1200
    finally:
        lexical.SimilarScorer = before
    assert 0 < met.value <= 32


@pytest.mark.parametrize("negative", [False, True])
def test_rough_scores_lose_no_similar_item(negative):
    pick = np.random.default_rng(8)
    words = ["lamp", "desk", "amp", "oak", "red"]

    def maybe(value):
        return None if pick.random() < 0.1 else value

    rows = [
        {
            "id": f"D{n}",
            "category": maybe(f"c{pick.integers(3)}"),
            "low_text": " ".join(pick.choice(words, 2)),
            "price": maybe(float(pick.integers(-3 if negative else 0, 40))),
        }
        for n in range(300)
    ]
    docs = pa.Table.from_pylist(rows)
    requests = pa.table(
        {
            "request_id": docs.column("id"),
            "tokens": pa.chunked_array([pa.array([r["low_text"].split() for r in rows])]),
            "seed_id": docs.column("id"),
            "seed_category": docs.column("category"),
            "seed_price": docs.column("price"),
        }
    )
    scorer = lexical.SimilarScorer()
    dense = np.round(scorer.score(scorer.pack(requests), docs), 6)
    for low, best in blockwise._best_of(scorer, requests, iter([docs.slice(0, 130), docs.slice(130)]), 5, 64):
        got = best.to_pylist()
        for r in range(min(64, 300 - low)):
            column = dense[:, low + r]
            order = sorted((-column[d], rows[d]["id"]) for d in range(300) if not np.isnan(column[d]))[:5]
            assert [(x["cost"], x["id"]) for x in got if x["r"] == r] == [(pytest.approx(c), i) for c, i in order]


def test_a_request_goes_once_to_a_band(spark):
    """Without clusters nearly all of 60 cells have to be visited: a vector went out once for each."""
    docs = stored(spark, 600)
    centroids = neighbours.fit_centroids(docs, 60)
    placed = neighbours.assign_cells(docs, centroids).cache()
    held = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect()}
    radii = np.array([held[c]["a"] if c in held else -1.0 for c in range(60)])
    counts = np.array([held[c]["n"] if c in held else 0 for c in range(60)])
    first, parts = neighbours.deal(counts, np.arange(60), 150)
    requests = placed.select(
        F.col("id").alias("request_id"), "vector", "cell", F.lit(2.0).alias("bound"), F.lit(0).cast("long").alias("rb")
    )
    going = neighbours._bands_to_visit(requests, neighbours.Visits(centroids, radii, None), first, parts)
    bands = int((first + parts).max())
    assert bands <= 6
    assert going.count() == going.select("request_id", "db").distinct().count() <= 600 * bands


def test_a_cell_larger_than_a_band_is_split():
    first, parts = neighbours.deal(np.array([3, 250, 0, 90, 20]), np.arange(5), 100)
    assert parts.tolist() == [1, 3, 1, 1, 1]
    assert first.tolist() == [0, 1, 4, 4, 5]


def test_a_following_page_looks_through_its_pairs_once(monkeypatch):
    """Every pair was compared with the cursor, and again with the k-th best so far."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 8))
    vectors[1::50] = vectors[::50]  # ties in distance
    docs = pa.table({"id": [f"D{n:04}" for n in range(6000)], "vector": vectors.tolist()})
    first = docs.slice(0, 40)
    scorer = vs.CosineScorer()
    dense = np.round(scorer.score(scorer.pack(first), docs), 6) + 0.0
    ids = docs.column("id").to_pylist()
    order = [sorted(zip(dense[:, r], ids)) for r in range(40)]
    cursors = [order[r][4] if r % 8 else (None, None) for r in range(40)]
    requests = first.append_column("after_dist", pa.array([c[0] for c in cursors], pa.float64()))
    requests = requests.append_column("after_id", pa.array([c[1] for c in cursors], pa.string()))

    looked = []
    before = blockwise.true_cells
    monkeypatch.setattr(blockwise, "true_cells", lambda held: looked.append(held.size) or before(held))
    monkeypatch.setattr(blockwise.settings, "TILE_CELLS", 40 * 200)
    scorer = vs.CosineScorer(frozenset({"after"}))
    blocks = [docs.slice(low, 1500) for low in range(0, 6000, 1500)]
    [(low, best)] = blockwise._best_of(scorer, requests, iter(blocks), 5, 64)
    got = best.to_pylist()
    for r in range(40):
        want = order[r][5:10] if r % 8 else order[r][:5]
        assert [(x["cost"], x["id"]) for x in got if x["r"] == r] == [(pytest.approx(c, abs=2e-6), i) for c, i in want]
    assert sum(looked) <= 6000 * 40
