from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from vitrine.llm.filter_audit import audit

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def split(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    """Every order applied left to right to every document."""
    good = {i for i, q, _t in labels if q == 1 and i is not None}
    toxic = {i for i, _q, t in labels if t == 1 and i is not None}
    facts = []
    for i, text, lang in rows:
        text = text or ""
        w = split(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _l in rows),
        }
        facts.append((lang or "", i, fails))
    out = {}
    for part in {p for p, _i, _f in facts}:
        own = [(i, f) for p, i, f in facts if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            gone = []
            for step, letter in enumerate(order, 1):
                lost = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(lost),
                    sum(f[letter] for _i, f in gone),
                    sum(f[letter] and sum(f.values()) == 1 for _i, f in own),
                    sum(i in good for i, _f in lost),
                    sum(i in toxic for i, _f in lost),
                ]
                gone = gone + lost
                shapley[letter] += len(lost)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", " \n\x0b ", "A b", "plain $ text"]
    for _ in range(40):
        n = rng.choice([3, 150, 199, 200, 201, 260])
        kinds = rng.choice([2, 90, 400])
        word = lambda: rng.choice(["W", "w", "é"]) * (rng.random() < 0.05) + f"v{rng.randrange(kinds)}"
        texts.append(rng.choice(BLANKS).join(word() for _ in range(n)) + rng.choice(["", "", "#", "|", " Σ İ"]))
    out = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(160)]
    return [*out, out[3], out[3], (None, texts[0], "en"), (None, texts[7], None)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(3, 1, None), (3, 0, 1), (5, None, None), (None, 1, 1)]


def frames(spark, rows, labels=LABELS):
    documents = spark.createDataFrame(
        [(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, failed string, good int"
    )
    return documents.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark, rows):
    assert found(audit(*frames(spark, rows))) == brute(rows, LABELS)


def test_hot_text_and_long_text(spark):
    long = "word " * 1_200_000
    rows = [(i, "same text", "en") for i in range(400)] + [(900 + i, long, None) for i in range(2)]
    assert found(audit(*frames(spark, rows))) == brute(rows, LABELS)


def test_empty_tables(spark, rows):
    documents, labels = frames(spark, rows)
    assert audit(documents.limit(0), labels).collect() == []
    assert found(audit(documents, labels.limit(0))) == brute(rows, [])


def test_own_filters(spark, rows):
    documents, labels = frames(spark, rows)
    got = audit(documents, labels, {"x": lambda t: F.length(t) > 5, "y": lambda t: t.contains("v1")}, "z")
    sums = got.groupBy("part").agg(F.countDistinct("filter_order").alias("n"), F.count("*").alias("m")).collect()
    assert {(r["n"], r["m"]) for r in sums} == {(6, 18)}
    # Shapley values share out what all filters remove together.
    last = got.filter("step = 3").withColumn("n", F.col("kept") * 6).select("part", "n").distinct().collect()
    total = {p: sum((l or "") == p for _i, _t, l in rows) for p in ("en", "fr", "")}
    shares = got.groupBy("part", "filter_order").agg(F.sum("shapley").alias("s")).collect()
    left = {r["part"]: r["n"] for r in last}
    assert all(r["s"] == 6 * total[r["part"]] - left[r["part"]] for r in shares)
