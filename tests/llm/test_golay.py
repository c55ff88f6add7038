from __future__ import annotations

import random

import numpy as np
import xxhash

from vitrine.llm.golay import DISTANCE, fuzzy_keys, keep_one_of_each, near_duplicates

from .conftest import tuples


def mark(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (text or "").translate(table).encode().split()
    if not w:
        return 0
    size = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    marks = [mark(t) for _i, t, *_ in docs]
    least = [i for i, *_ in docs]
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                if (marks[a] ^ marks[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return sorted((d[0], m - (1 << 64) if m >> 63 else m, c) for d, m, c in zip(docs, marks, least))


def test_against_brute_force(documents, sample):
    found = tuples(near_duplicates(documents), "id", "mark", "component")
    assert found == brute(sample)
    assert len({r[2] for r in found}) < len(found)


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, DISTANCE, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(*(x.tolist() for x in fuzzy_keys(m)))) for m in (a, b)]
    assert {row for row, _ in keys[0] & keys[1]} == set(range(3000))


def test_dense_group(spark):
    """A long chain of near copies in one bucket keeps all its links."""
    rng = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(150):
        words[rng.randrange(400)] = f"u{i}"
        rows.append((1000 - i, " ".join(words), None, None))
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4)
    assert tuples(near_duplicates(docs), "id", "mark", "component") == brute(rows)


def test_one_stays(documents, sample):
    kept = keep_one_of_each(documents.filter("doc_id <> 5"))
    assert kept.columns == documents.columns
    wanted = {c for _i, _m, c in brute([r for r in sample if r[0] != 5])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_empty(no_documents):
    assert near_duplicates(no_documents).collect() == []
    assert keep_one_of_each(no_documents).collect() == []
