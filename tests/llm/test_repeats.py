from __future__ import annotations

import hashlib

import pytest

from vitrine.llm.repeats import repeat_digests, with_spans

from .conftest import texts, tuples


def brute(docs, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in docs]
    seen: dict[bytes, int] = {}
    for _i, b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


COLUMNS = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("length", [40, 200])
def test_against_brute_force(documents, sample, length):
    found = tuples(repeat_digests(documents, length=length), *COLUMNS)
    assert found == brute(sample, length)
    assert any(0 < r[2] < r[1] for r in found)


@pytest.mark.parametrize("seed", [11, 12])
def test_many_near_copies(spark, seed):
    rows = [(i, t) for i, t in enumerate(texts(seed, 250))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert tuples(repeat_digests(docs), *COLUMNS) == brute(rows, 200)


def test_periodic_texts(spark):
    rows = [(1, "ab" * 150), (2, "ba" * 101), (3, "a" * 200), (4, "a" * 199), (5, "é" * 130 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(repeat_digests(docs), *COLUMNS) == brute(rows, 200)


def test_spans_are_kept(documents):
    for _id, text, starts, stops in with_spans(documents, "doc_id", "text", 40).collect():
        assert all(b < a for b, a in zip(stops or [], (starts or [])[1:]))
        assert not stops or stops[-1] <= len(text.encode())


def test_empty(no_documents):
    assert repeat_digests(no_documents).collect() == []
