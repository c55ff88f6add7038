from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import vectors as V
from vitrine.operators import drops, fusion, history, lexical
from vitrine.operators import vector_search as vs
from vitrine.operators.embedding import hashed_tokens_encoder
from vitrine.operators.neighbours import all_neighbours
from vitrine.plans import search_job

DOC = "id string, category string, vector array<float>, upserted_at long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(300):
        v = rng.normal(size=16)
        v /= np.linalg.norm(v)
        rows.append((f"D{n}", f"c{n % 4}", [float(x) for x in v], n))
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


def brute(docs, k, keep=lambda a, b: True):
    """Reference ranking in plain numpy."""
    rows = docs.collect()
    vectors = np.array([r["vector"] for r in rows], dtype=np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T, 6) + 0.0
    out = {}
    for a, row in enumerate(rows):
        ranked = sorted((dist[a, b], other["id"]) for b, other in enumerate(rows) if keep(row, other))
        out[row["id"]] = [(i, d) for d, i in ranked[:k]]
    return out


def listed(hits):
    out = {}
    for r in hits.orderBy("request_id", "rank").collect():
        out.setdefault(r["request_id"], []).append((r["id"], r["dist"]))
    return out


def every(docs):
    return docs.select(F.col("id").alias("request_id"), "vector")


def same(got, wanted):
    assert got.keys() == {k for k, v in wanted.items() if v}
    for key, hits in got.items():
        assert [h[0] for h in hits] == [h[0] for h in wanted[key]], key
        assert [h[1] for h in hits] == pytest.approx([h[1] for h in wanted[key]], abs=1e-6)


PATHS = [{}, {"broadcast_limit": 10, "block_docs": 64, "block_requests": 50}]


@pytest.mark.parametrize("limits", PATHS)
def test_top_k_matches_brute_force(docs, limits):
    same(listed(vs.vector_top_k(docs, every(docs), 7, **limits)), brute(docs, 7))


@pytest.mark.parametrize("limits", PATHS)
def test_conditions_per_request(docs, limits):
    requests = every(docs).join(
        docs.select(
            F.col("id").alias("request_id"),
            F.when(F.col("upserted_at") % 2 == 0, F.col("category")).alias("category"),
            F.when(F.col("upserted_at") % 3 > 0, F.col("upserted_at") - 40).alias("lo"),
            F.when(F.col("upserted_at") % 3 > 0, F.col("upserted_at") + 40).alias("hi"),
            F.col("id").alias("exclude_id"),
        ),
        "request_id",
    )

    def keep(a, b):
        at = a["upserted_at"]
        return (
            a["id"] != b["id"]
            and (at % 2 == 1 or a["category"] == b["category"])
            and (at % 3 == 0 or at - 40 < b["upserted_at"] <= at + 40)
        )

    same(listed(vs.vector_top_k(docs, requests, 5, **limits)), brute(docs, 5, keep))


def test_paging_walks_the_whole_ranking(docs):
    requests = every(docs.filter(F.col("upserted_at") < 3))
    wanted = brute(docs, 300)
    seen = {}
    page = vs.vector_top_k(docs, requests, 120)
    for _ in range(3):
        for key, hits in listed(page).items():
            seen.setdefault(key, []).extend(h[0] for h in hits)
        following = requests.join(vs.next_cursor(page, 120), "request_id")
        page = vs.vector_top_k(docs, following, 120)
    assert seen == {k: [h[0] for h in wanted[k]] for k in seen}
    assert vs.next_cursor(page, 120).isEmpty()


def test_equal_distances_rank_by_id(spark):
    same_vector = [(f"D{n:04d}", "c", [1.0, 0.0], n) for n in range(5000)]
    docs = spark.createDataFrame(same_vector, DOC).repartition(6)
    request = spark.createDataFrame([("q", [1.0, 0.0])], "request_id string, vector array<float>")
    got = listed(vs.vector_top_k(docs, request, 4))
    assert got == {"q": [("D0000", 0.0), ("D0001", 0.0), ("D0002", 0.0), ("D0003", 0.0)]}


def test_radius_count_and_zero_hits(docs, spark):
    requests = every(docs).withColumn("category", F.lit("c1"))
    got = {r["request_id"]: r["count"] for r in vs.radius_count(docs, requests, 0.9).collect()}
    wanted = brute(docs, 300, lambda a, b: b["category"] == "c1")
    assert got == {k: sum(d <= 0.9 for _, d in v) for k, v in wanted.items()}
    nothing = vs.radius_count(docs.filter("id = 'none'"), requests, 0.9)
    assert {r["count"] for r in nothing.collect()} == {0}


def test_bounds_are_checked(docs):
    with pytest.raises(ValueError):
        vs.vector_top_k(docs, every(docs), 0)
    with pytest.raises(ValueError):
        vs.vector_top_k(docs, every(docs), 201)
    with pytest.raises(ValueError):
        vs.radius_count(docs, every(docs), 2.1)


def test_unknown_seed_is_reported_and_skipped(docs, spark):
    seeds = spark.createDataFrame([("r", "D1"), ("s", "nope")], "request_id string, seed_id string")
    resolved = {r["seed_id"]: r["missing"] for r in vs.resolve_seeds(docs, seeds).collect()}
    assert resolved == {"D1": False, "nope": True}
    got = listed(vs.nearest_to_id(docs, seeds, 3))
    assert set(got) == {"r"} and "D1" not in [h[0] for h in got["r"]]


@pytest.mark.parametrize("sizes", [{}, {"cells": 1}, {"cells": 12, "block_docs": 20, "block_requests": 15}])
def test_all_neighbours_exact(docs, sizes):
    same(listed(all_neighbours(docs, 6, **sizes)), brute(docs, 6, lambda a, b: a["id"] != b["id"]))


def test_all_neighbours_on_clusters(spark):
    """Clustered vectors with one cell far larger than the rest."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16))
    rows = []
    for n in range(240):
        cluster = 0 if n % 3 == 0 else n % 6
        v = centres[cluster] + rng.normal(size=16) * 0.05
        rows.append((f"D{n}", "c", [float(x) for x in v], n))
    docs = spark.createDataFrame(rows, DOC)
    wanted = brute(docs, 5, lambda a, b: a["id"] != b["id"])
    same(listed(all_neighbours(docs, 5, cells=6, block_docs=16, block_requests=16)), wanted)
    probed = listed(all_neighbours(docs, 5, cells=6, probes=2))
    hits = sum(len({h[0] for h in probed[k]} & {h[0] for h in wanted[k]}) for k in wanted)
    assert hits / sum(len(v) for v in wanted.values()) > 0.95


def test_fusion(spark, rows):
    seeds = spark.createDataFrame(
        [("r", 0, "A"), ("r", 1, "B"), ("r", 2, "A"), ("r", 3, ""), ("one", 0, "A"), ("one", 1, "A")],
        "request_id string, pos int, seed_id string",
    )
    legs = fusion.request_seeds(seeds)
    assert sorted(rows(legs)) == [("r", 0, "A"), ("r", 1, "B")]
    hits = spark.createDataFrame(
        [("A", "X", 1), ("A", "B", 2), ("A", "Y", 3), ("B", "Z", 1), ("B", "Y", 2), ("B", "A", 3)],
        "seed_id string, id string, rank int",
    )
    got = fusion.fuse(legs, hits).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["Y", "X", "Z"]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 62)
    assert got[1]["score"] == got[2]["score"] == pytest.approx(1 / 61)


def test_fusion_caps_seeds(spark):
    seeds = spark.createDataFrame([("r", n, f"S{n}") for n in range(30)], "request_id string, pos int, seed_id string")
    assert fusion.request_seeds(seeds).count() == 16


def test_featured(spark, rows):
    hits = spark.createDataFrame(
        [(0, 1, "A"), (0, 2, "B"), (1, 1, "B"), (1, 2, "C"), (1, 7, "late"), (2, 1, "A")],
        "query_pos int, rank int, id string",
    )
    assert [r[2] for r in rows(fusion.featured(hits))] == ["A", "B", "C"]


def test_history(spark, rows):
    views = spark.createDataFrame(
        [(n, 1, f"D{n % 15}", 100 + n) for n in range(40)] + [(99, 1, "D0", 10)],
        "event_id long, user_id long, doc_id string, ts_ms long",
    )
    got = history.recent_views(views).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [f"D{n % 15}" for n in range(39, 27, -1)]
    searches = spark.createDataFrame(
        [(1, 1, " Red  Lamp", 1), (2, 1, "red lamp", 2), (3, 1, "  ", 3), (4, 1, "desk", 4)],
        "event_id long, user_id long, raw_query string, timestamp_ms long",
    )
    assert [r["query"] for r in history.recent_searches(searches).orderBy("place").collect()] == ["desk", "red lamp"]


def products(spark):
    return spark.createDataFrame(
        [
            ("a", "Desk Lamp", "warm light", "home", 4.0, 9.0, 10.0),
            ("b", "Lamp", "desk lamp for reading", "lamp", 4.0, 0.0, 20.0),
            ("c", "Chair", "oak", "home", 5.0, 999.0, 10.0),
            ("d", "Stool", "pine", "home", 3.0, 0.0, None),
        ],
        "id string, title string, description string, category string, rating double, rating_count double, price double",
    )


def test_lexical_scores(spark):
    queries = spark.createDataFrame([("q", "Lamp, lamp a"), ("none", "? !")], "request_id string, query string")
    got = {r["id"]: (r["score"], r["rank"]) for r in lexical.lexical_top_k(products(spark), queries).collect()}
    # The query repeats its token; one-letter tokens do not count.
    assert got == {
        "b": (2 * (4 + 3 + 1), 1),
        "a": (pytest.approx(2 * (4 + 1) + 0.4), 2),
        "c": (pytest.approx(0.4 * 3 + 0.5), 3),
    }


@pytest.mark.parametrize("seed", range(3))
def test_lexical_against_every_pair(spark, seed):
    """Substrings inside runs, repeated tokens, unrated and negative documents, equal scores."""
    rng = random.Random(seed)
    parts = ["ab", "abc", "bca", "xab", "cabx", "zz9", "9", "Übca", "a-b", "zz", "q"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice(["", " ", "-", "é"]) for _ in range(n))
    docs = [
        (f"d{i:03}", rng.choice([None, text(2)]), rng.choice([None, text(6)]), rng.choice(["ab", "ABC", "c d", None]),
         rng.choice([None, 1.0, 4.0, 4.5]), rng.choice([None, 0.0, 9.0, 9.0]))
        for i in range(120)
    ]
    asked = [(f"q{i}", text(rng.randrange(1, 4))) for i in range(25)] + [("none", "? é"), ("same", "ab zz"), ("again", "zz AB")]
    schema = "id string, title string, description string, category string, rating double, rating_count double"
    got = lexical.lexical_top_k(
        spark.createDataFrame(docs, schema), spark.createDataFrame(asked, "request_id string, query string"), 7
    )
    split = lambda s: [t for t in re.split("[^a-z0-9]+", s.lower()) if len(t) > 1]
    wanted = []
    for name, words in asked:
        scored = []
        for i, title, description, category, rating, count in docs:
            if rating is None or count is None or not split(words):
                continue
            title, description, category = ((v or "").lower() for v in (title, description, category))
            whole = f"{title} {description} {category}"
            score = sum(4 * (t in title) + 3 * (t == category) + (t in whole) for t in split(words))
            score += 0.4 * math.log10(count + 1) + 0.5 * (rating - 4)
            if score > 0:
                scored.append((-round(score, 6), i))
        wanted += [(name, i, -s, place) for place, (s, i) in enumerate(sorted(scored)[:7], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_similar_scores(spark):
    seeds = spark.createDataFrame([("r", "a"), ("x", "unknown")], "request_id string, seed_id string")
    got = {r["id"]: r["score"] for r in lexical.similar_items(products(spark), seeds).collect()}
    assert got == {"b": pytest.approx(2 + 0.75), "c": pytest.approx(5 + 1.5), "d": pytest.approx(5.0)}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(
        V.l2_norm(F.col("a")), V.l2_normalize(F.col("a")), V.cosine_distance(F.col("a"), F.col("b"))
    ).first()
    assert got[0] == 5.0 and got[1] == pytest.approx([0.6, 0.8]) and got[2] == pytest.approx(0.2)


def test_text_search_with_drop(spark):
    docs = spark.createDataFrame(
        [("a", "desk lamp", "home", 50), ("b", "desk lamp", "home", 150), ("c", "oak chair", "home", 150)],
        "id string, text string, category string, upserted_at long",
    )
    from vitrine.operators.embedding import embed_texts

    encoder = hashed_tokens_encoder(32)
    stored = embed_texts(docs, encoder)
    marks = spark.createDataFrame([("new", 200, 2), ("old", 100, 1)], "label string, watermark_ms long, row_count long")
    requests = spark.createDataFrame(
        [("r1", " desk lamp ", "new"), ("r2", "desk lamp", None), ("r3", "", "new"), ("r4", "desk", "none")],
        "request_id string, query string, label string",
    )
    got = listed(search_job.search(stored, requests, encoder, marks))
    assert [h[0] for h in got["r1"]] == ["b", "c"]
    assert [h[0] for h in got["r2"]] == ["a", "b", "c"]
    assert set(got) == {"r1", "r2"}
    refused = search_job.refused_requests(requests, marks, lookup=1).collect()
    assert list(map(tuple, refused)) == [("r4", "unknown catalog checkpoint: none")]


# --- Drops ---

MARKS = "label string, watermark_ms long, row_count long"


def marks(spark):
    return spark.createDataFrame([("catalog-2026-06-08", 1000, 7), ("catalog-2026-06-09", 2000, 5)], MARKS)


def test_checkpoint_windows(spark, rows):
    wanted = [("catalog-2026-06-08", 0, 1000), ("catalog-2026-06-09", 1000, 2000)]
    assert sorted(rows(drops.checkpoint_windows(marks(spark)))) == wanted
    assert sorted(rows(drops.checkpoint_windows(marks(spark), None))) == wanted
    # The last label in reach still gets its true lower bound.
    assert rows(drops.checkpoint_windows(marks(spark), 1)) == [wanted[1]]


def test_membership_edges(spark):
    docs = spark.createDataFrame([(t,) for t in (-5, 0, 1, 1000, 1001, 2000, 2001)], "upserted_at long")
    for limit in (100, 0):
        got = {r[0]: r[1] for r in drops.drop_membership(docs, marks(spark), broadcast_limit=limit).collect()}
        old, new = "catalog-2026-06-08", "catalog-2026-06-09"
        assert got == {-5: None, 0: None, 1: old, 1000: old, 1001: new, 2000: new, 2001: None}


def test_membership_without_checkpoints(spark):
    docs = spark.createDataFrame([(1,)], "upserted_at long")
    assert drops.drop_membership(docs, marks(spark).limit(0)).first()["label"] is None


def test_ledger_limits(spark, rows):
    assert [r[0] for r in rows(drops.drop_ledger(marks(spark), 1))] == ["catalog-2026-06-09"]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            drops.drop_ledger(marks(spark), limit)


def test_browse(spark, rows):
    docs = spark.createDataFrame([(f"B{n:04d}", 1500) for n in range(1, 4)], "id string, upserted_at long")
    page = drops.browse_page(docs, (1000, 2000), 1)
    assert rows(page.select("id", "next_cursor")) == [("B0001", "id:B0001")]
    last = drops.browse_page(docs, (1000, 2000), 2, "id:B0001")
    assert rows(last.select("id", "next_cursor")) == [("B0002", None), ("B0003", None)]
    with pytest.raises(ValueError, match="empty"):
        drops.browse_page(docs, (1000, 2000), 1, "id:")


def test_offset_cursor_forms(spark):
    given = [None, "", "12", "-1", "x", "scan:s:5", "scan:s:", "scan::5", "scan:s", "scan:s:-2"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "i int, cursor string")
    got = [(r["valid"], r["scan_id"], r["offset"]) for r in drops.offset_cursors(df).orderBy("i").collect()]
    bad = (False, None, None)
    assert got == [(True, None, 0), (True, None, 0), (True, None, 12), bad, bad, (True, "s", 5), bad, bad, bad, bad]


def test_rotating_slice_wraps(spark):
    docs = spark.createDataFrame([(f"D{n}",) for n in range(7)], "id string")
    h = 0
    for c in "catalog-2024-01-01":
        h = (h * 31 + ord(c)) % 997
    got = [r["id"] for r in drops.rotating_slice(docs, "catalog-2024-01-01", 5).orderBy("place").collect()]
    assert got == [f"D{(h + i) % 7}" for i in range(5)]
    assert drops.rotating_slice(docs, "x", 50).count() == 7
    assert math.isclose(drops.rotating_slice(docs.limit(0), "x", 5).count(), 0)


def test_zero_vectors_have_no_neighbours(spark):
    """Both ways of answering leave a vector without a direction out."""
    from vitrine.operators.neighbours import all_neighbours
    from vitrine.operators.vector_search import nearest_to_id

    rows = [(f"v{i:02d}", [float(i % 5 - 2), float(i % 7 - 3), 1.0]) for i in range(40)] + [("z", [0.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "id string, vector array<double>")
    every = all_neighbours(docs, 4, cells=5).select("request_id", "id", "dist").collect()
    asked = docs.select(F.col("id").alias("request_id"), F.col("id").alias("seed_id")).filter("seed_id <> 'z'")
    one = nearest_to_id(docs, asked, 4).filter("id is not null").select("request_id", "id", "dist").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, one))
    assert "z" not in {r["id"] for r in every} | {r["request_id"] for r in every}


def test_count_row_over_an_empty_table(spark):
    from vitrine.operators.vector_search import search_with_count

    docs = spark.createDataFrame([], "id string, vector array<double>")
    requests = spark.createDataFrame([("r", [1.0, 0.0])], "request_id string, vector array<double>")
    assert [tuple(r) for r in search_with_count(docs, requests, 3).collect()] == [("r", 0, None, None, 0)]
