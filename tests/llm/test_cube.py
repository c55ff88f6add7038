from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm.cube import flight, landing, mix, mixed_documents, word_count

from .conftest import tuples


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by hand over {source: size}, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


@pytest.fixture(scope="module")
def many(spark):
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return spark.range(30000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 501 == 0, None).otherwise(source).alias("source"),
        (F.pmod(F.hash("id"), F.lit(900)) + F.when(F.col("id") % 4000 == 0, 30000).otherwise(0)).alias("size"),
    )


def test_sums_meet_targets(many):
    found = mix(many, F.col("size"), block=512).groupBy("source").agg(
        F.first("source_size").alias("size"), F.first("target").alias("target"),
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.sum("copies").alias("copies"),
        F.count("*").alias("n"), F.max("copies").alias("most"),
    ).collect()
    wanted = targets({r.source: r["size"] for r in found})
    for r in found:
        assert r.target == pytest.approx(wanted[r.source])
        assert abs(r.taken - r.target) < 2000
        assert abs(r.copies - r.n * r.target / r["size"]) < 3
        assert r.most <= 2


def test_reruns_agree(many):
    small = many.filter("doc_id < 3000")
    one = tuples(mix(small, F.col("size"), block=128), "id", "source", "copies")
    assert one == tuples(mix(small.repartition(7), F.col("size"), block=128), "id", "source", "copies")


def test_awkward_rows(documents, sample):
    found = mix(documents, word_count("text")).collect()
    assert len(found) == len(sample)
    sizes = {}
    for _i, text, _lang, source in sample:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets(sizes)[r.source])
        assert 0 <= r.copies <= 2


def test_no_words_take_nothing(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.copies) for r in mix(rows, word_count("text")).collect()] == [(0.0, 0), (0.0, 0)]


def test_empty(no_documents):
    assert mix(no_documents, word_count("text")).collect() == []
    assert mixed_documents(no_documents).collect() == []


def test_mixed_documents_take_effect(documents):
    chosen = {(r.id, r.source): r.copies for r in mix(documents, word_count("text")).collect()}
    out = mixed_documents(documents)
    assert set(documents.columns) <= set(out.columns)
    rows = out.collect()
    assert {(r.doc_id, r.source): r.copies for r in rows} == {k: v for k, v in chosen.items() if v}


def test_flight_keeps_sums_and_leaves_two():
    rng = np.random.RandomState(1)
    size = rng.randint(0, 1000, 500).astype(float)
    chance = np.full(500, 0.37)
    out = flight(size, chance, np.random.RandomState(2))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(chance.sum())
    assert (out * size).sum() == pytest.approx((chance * size).sum())


def test_chances_are_kept():
    size = np.array([3.0, 5.0, 7.0, 7.0, 11.0, 2.0])
    chance = np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.3])
    total = np.zeros(6)
    for seed in range(4000):
        rng = np.random.RandomState(seed)
        total += landing(size, flight(size, chance, rng), rng)
    assert np.abs(total / 4000 - chance).max() < 0.03
