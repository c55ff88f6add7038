"""Hashed neighbour search against brute force, on clusters, copies and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators.hashed_neighbours import crossings, hashed_neighbours, probe_codes, recall
from vitrine.operators.neighbours import all_neighbours

DOC = "id string, vector array<float>"


def table(spark, vectors, prefix="D"):
    rows = [(f"{prefix}{n:05d}", None if v is None else [float(x) for x in v]) for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, DOC).repartition(6)


def listed(df):
    found = {}
    for r in df.orderBy("request_id", "rank").collect():
        found.setdefault(r["request_id"], []).append((r["rank"], r["id"], round(r["dist"], 5)))
    return found


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 40), 24))
    return centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, 24))


def test_probes_start_at_the_own_bucket_and_differ():
    margins = np.random.default_rng(1).normal(size=(50, 7))
    codes = probe_codes(margins, 12)
    assert codes.shape == (50, 12)
    assert (codes[:, 0] == ((margins > 0) @ (1 << np.arange(7)))).all()
    assert all(len(set(row)) == 12 for row in codes)
    # The second bucket lies behind the closest plane.
    crossed = codes[:, 0] ^ codes[:, 1]
    assert (crossed == 1 << np.argmin(np.abs(margins), axis=1)).all()
    assert len(crossings(0)) == 1 and probe_codes(margins[:, :0], 5).shape == (50, 1)


@pytest.mark.parametrize("sizes", [{"bits": 0}, {"bits": 0, "block_rows": 40}, {"bits": 2, "probes": 4, "tables": 3}])
def test_every_bucket_probed_is_exact(spark, sizes):
    docs = table(spark, clustered(240))
    assert listed(hashed_neighbours(docs, 6, **sizes)) == listed(all_neighbours(docs, 6))


def test_recall_and_bounded_blocks(spark):
    docs = table(spark, clustered(1500))
    exact = all_neighbours(docs, 8).cache()
    whole = hashed_neighbours(docs, 8).cache()
    figures = recall(exact, whole).first()
    assert figures["neighbours"] == 12_000 and figures["recall"] >= 0.9
    # Splitting crowded buckets changes nothing.
    assert listed(hashed_neighbours(docs, 8, block_rows=16)) == listed(whole)
    nearest = {(r["request_id"], r["rank"]): r["dist"] for r in exact.collect()}
    assert all(r["dist"] >= nearest[r["request_id"], r["rank"]] - 2e-6 for r in whole.collect())


def test_a_large_class_of_equals(spark):
    """A third of the rows are one vector: its first ids stand for all of them."""
    vectors = list(clustered(120)) + [np.ones(24)] * 60
    docs = table(spark, vectors)
    got = listed(hashed_neighbours(docs, 5, bits=0))
    assert got == listed(all_neighbours(docs, 5))
    assert [i for _, i, _ in got["D00120"]] == [f"D{n:05d}" for n in range(121, 126)]
    assert [i for _, i, _ in got["D00179"]] == [f"D{n:05d}" for n in range(120, 125)]


def test_null_zero_lonely_and_empty(spark):
    docs = table(spark, [None, np.zeros(24), *clustered(30)])
    assert not {"D00000", "D00001"} & set(listed(hashed_neighbours(docs, 3)))
    alone = table(spark, [np.ones(4)])
    assert hashed_neighbours(alone, 3).isEmpty()
    assert hashed_neighbours(docs.limit(0), 3).isEmpty()
    assert recall(hashed_neighbours(docs.limit(0), 3), hashed_neighbours(alone, 3)).first()["recall"] is None


def test_seeds_only(spark):
    docs = table(spark, clustered(200)).withColumn("cell", F.lit("clash"))
    seeds = docs.filter("id in ('D00003', 'D00150')").select("id")
    every = listed(hashed_neighbours(docs, 4, bits=2))
    assert listed(hashed_neighbours(docs, 4, bits=2, seeds=seeds)) == {k: every[k] for k in ("D00003", "D00150")}
