from __future__ import annotations

import hashlib
import re

import numpy as np

from vitrine.llm.personal import (
    KINDS,
    accepted,
    expectation_maximisation,
    luhn,
    packed,
    personal_spans,
    strict,
    unpacked,
    written,
)

from .conftest import tuples

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((KINDS.index(kind), *m.span()))
    return sorted(out)


TEXTS = [
    "mail a.b@c.de, x@@y.com, @z.com, é@q.org, a@b@c.d.e- and long" + "a" * 500 + "@host.com.",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 but 001.02.3.255 or 1.2.3 and 10.0.0.1.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111123 12 34",
    "call +1 (988) 555-2485 or +49 30 1234567890123456 or +12 or ++1 234 567 89",
    "1" * 3000 + " " + "1." * 500 + " " + "+1" + "(" * 800,
    "",
    "nothing here",
    "4111 1111 1111 1111 4111 1111 1111 1111",
]


def test_strict_forms_against_plain_expressions(sample):
    for text in TEXTS + [t for _i, t, *_ in sample if t]:
        assert sorted(strict(text)) == plain(text)


def test_query_rows(spark):
    rows = list(enumerate(TEXTS)) + [(50, None), (1, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = personal_spans(docs)
    from pyspark.sql import functions as F

    got = tuples(found.select("id", F.sha2(written(F.filter("found", lambda f: f.base)), 256).alias("h")), "id", "h")
    want = []
    for i, text in rows:
        names = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(text or ""))
        want.append((i, hashlib.sha256(names.encode()).hexdigest()))
    assert got == sorted(want)
    for r in found.collect():
        assert [f for f in r.kept if f.base] == [f for f in r.found if f.base]


def test_looser_forms_need_support(spark):
    rows = [(i, f"Contact: call phone (988) 555-{1000 + i}, mail: joe{i} [at] host{i} [dot] com now") for i in range(60)]
    rows += [(100 + i, f"part 123-456-{1000 + i} in stock") for i in range(60)]
    rows += [(200 + i, f"phone +1 (988) 555-{1000 + i}, mail a{i}@b.com") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.id: [(KINDS[f.kind], f.base) for f in r.kept] for r in personal_spans(docs).collect()}
    assert all(kept[i] == [("email", False), ("phone", False)] for i in range(60))
    assert all(kept[100 + i] == [] for i in range(60))
    assert all(kept[200 + i] == [("email", True), ("phone", True)] for i in range(60))


def test_patterns_pack():
    for values in ((1, -1, 0, 1, 0, -1), (-1,) * 6, (1,) * 6):
        assert tuple(unpacked(packed(values))) == values


def test_reliabilities_are_found():
    rng = np.random.RandomState(3)
    truth = rng.rand(5000) < 0.4
    votes = np.zeros((5000, 6), int)
    for j, accuracy in enumerate((0.95, 0.9, 0.8, 0.7, 0.6, 0.5)):
        right = rng.rand(5000) < accuracy
        votes[:, j] = np.where(right == truth, 1, -1) * (rng.rand(5000) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = expectation_maximisation(patterns, counts.astype(float))
    good = model.posterior(votes) > 0.5
    # Better than giving every labeler one vote.
    assert (good == truth).mean() > ((votes.sum(1) > 0) == truth).mean() + 0.01
    strength = model.right.sum(0)
    assert strength[0] > strength[2] > strength[4]


def test_reliabilities_leave_the_first_guess():
    rng = np.random.RandomState(4)
    truth = rng.rand(20000) < 0.5
    sure = np.array([0.99] * 5 + [0.5])
    votes = np.where((rng.rand(20000, 6) < sure) == truth[:, None], 1, -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    right = expectation_maximisation(patterns, counts.astype(float)).right
    assert (abs(right[:, :5] - 0.99) < 0.01).all() and (abs(right[:, 5] - 0.5) < 0.05).all()


def valid_card(rng):
    digits = "4" + "".join(str(rng.randint(10)) for _ in range(14))
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def test_planted_looser_forms(spark):
    """Precision and recall over forms that the strict expressions miss, among such that only look alike."""
    rng = np.random.RandomState(6)
    good, bad, rows = set(), set(), []

    def plant(before, span, after, kind, personal):
        i = len(rows)
        rows.append((i, f"{before} {span} {after}"))
        if personal is not None:
            (good if personal else bad).add((i, kind, len(before) + 1, len(before) + 1 + len(span)))

    for n in range(150):
        phone = f"{rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        plant("some words", f"+1 ({phone}", "and more", 3, None)
        plant("some words", valid_card(rng), "and more", 2, None)
        plant("some words", f"ann{n}@mail{n % 9}.example.com", "and more", 0, None)
    for n in range(40):
        plant("of the", valid_card(rng), f"{rng.randint(1000, 9999)} 77 items", 2, True)
        plant("reach me by phone", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "today", 3, True)
        plant("please mail", f"bob{n} [at] site{n} [dot] com", "soon", 0, True)
        plant("please mail", f"eve{n} at site{n} dot org", "soon", 0, True)
        card = valid_card(rng)
        plant("order number", "9" + card[1:], "ships", 2, False)
        plant("part", f"123-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", "in stock", 3, False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {(r.id, f.kind, f.start, f.stop) for r in personal_spans(docs).collect() for f in r.kept if not f.base}
    assert len(added & good) >= 0.9 * len(good)
    assert len(added & good) >= 0.95 * len(added)
    assert not added & bad


def test_nothing_to_learn(no_documents):
    assert accepted([], 0.9) == []
    assert personal_spans(no_documents).collect() == []
