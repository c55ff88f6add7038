from __future__ import annotations

import re

import pytest

from vitrine.llm.winnowing import contamination, drop_contaminated

from .conftest import tuples

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(table))


def brute(docs, items):
    out = []
    for doc, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            size = min(10, len(w))
            for p in range(len(w) - size + 1 if w else 0):
                for q in range(len(own) - size + 1):
                    if own[q : q + size] == w[p : p + size]:
                        hit.update(range(q, q + size))
                        if item is not None:
                            found.add(str(item))
        out.append((doc, len(own), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def items(sample):
    texts = [t for _i, t, *_ in sample if t and len(t) > 400]
    out = [(i, t[40:300].upper()) for i, t in enumerate(texts[:12])]
    out += [(100, "one"), (100, "one"), (101, None), (102, " . "), (9, texts[0][50:320]), (7, "w1 w2"), (103, "nowhere at all")]
    return out


def test_against_brute_force(spark, documents, sample, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = tuples(contamination(documents, benchmark), "id", "n_words", "n_hit", "items")
    assert found == sorted(brute(sample, items), key=lambda r: tuple(map(str, r))) or sorted(
        map(str, found)
    ) == sorted(map(str, brute(sample, items)))
    assert any(r[2] for r in found)


def test_spans_cover_the_hits(spark, documents, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for n_hit, spans in contamination(documents, benchmark).select("n_hit", "spans").collect():
        assert n_hit == sum(b - a for a, b in spans)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_drop_keeps_clean_rows_and_columns(spark, documents, sample, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = [r[0] for r in brute(sample, items) if r[2] == 0]
    kept = drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)


def test_empty_tables(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_documents, none).collect() == []
    assert contamination(documents, none).filter("n_hit > 0").collect() == []
    assert drop_contaminated(documents, none).count() == documents.count()
