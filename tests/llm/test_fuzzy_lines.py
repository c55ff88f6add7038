from __future__ import annotations

import random
import re

import pytest

from vitrine.llm.fuzzy_lines import dedupe_lines, edit_distance, similar

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(90))] for _ in range(2))
        assert edit_distance(a, b) == table_distance(a, b)
        for s in (0.5, 0.8):
            want = table_distance(a, b) <= (1 - s) * max(len(a), len(b)) + 1e-9
            assert similar(a, b, s) == want


def brute(docs, marks, distance, min_words=5):
    """Marks of the lines come from the operator; links, groups and first places by hand."""
    places, forms = [], {}
    for i, text, *_ in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line.translate(LOWER))
            if w:
                form = " ".join(w)
                places.append(((i, n), form))
                forms.setdefault(form, (i, n))
    names = list(forms)
    group = {f: f for f in names}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            v, w = x.split(), y.split()
            if min(len(v), len(w)) < min_words:
                continue
            near = (marks[x] ^ marks[y]).bit_count() <= distance
            if near and table_distance(v, w) <= 0.2 * max(len(v), len(w)) + 1e-9:
                group[root(x)] = root(y)
    first = {}
    for place, form in places:
        first[root(form)] = min(first.get(root(form), place), place)
    return {place for place, form in places if first[root(form)] != place}


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(4, 40))] for _ in range(40)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            own = list(rng.choice(base))
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = rng.choice(words)
            text.append(rng.choice([" ", ", "]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
        docs.append((i, "\n".join(text)))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, "La.\nLa.\nLa."), (104, docs[0][1] + "\n")]


def test_against_brute_force(spark, lines):
    import numpy as np

    from vitrine.llm.fuzzy_lines import Lines

    docs = spark.createDataFrame(lines, "doc_id long, text string").repartition(4)
    marks = {}
    for _i, text in lines:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        own = Lines(raw, np.array([0, len(raw)]), 5)
        for k, m in enumerate(own.marks().tolist()):
            marks[own.normal(own.text.tobytes(), k).decode()] = m
    gone = brute(lines, marks, 6)
    found = {r.doc_id: r for r in dedupe_lines(docs).collect()}
    assert {(i, n) for i, r in found.items() for n in r._gone or []} == gone
    for i, text in lines:
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)
        assert found[i].text == kept
    # More than equal lines alone.
    assert len(gone) > len(brute(lines, marks, -1))


def test_awkward_rows(documents, sample):
    out = dedupe_lines(documents)
    assert set(documents.columns) <= set(out.columns)
    assert out.count() == len(sample)


def test_empty(no_documents):
    assert dedupe_lines(no_documents).collect() == []


def test_equal_lines_of_any_length(spark):
    """Short lines and long ones of unspaced scripts are kept once; lines without words stay."""
    unspaced = "".join(chr(0x3042 + i % 40) for i in range(300))
    rows = [(1, f"Yes\n---\n{unspaced}"), (2, f"no\nyes.\n---\n{unspaced}。"), (3, f"---\n\n{unspaced}\nYES")]
    found = {r.doc_id: r for r in dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]._gone is None
    assert found[2].text == f"no\n---\n{unspaced}。"
    assert found[3].text == "---\n"
