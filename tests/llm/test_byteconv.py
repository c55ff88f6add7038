from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm.byteconv import PAD, Scorer, fit, fresh, languages, padded, responses, softmax

def usable():
    return F.crc32(F.col("id").cast("string")) % 3 != 1


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    # Enough rows for every language: numbers are added in front of copies of the smallest table.
    more = docs.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"), "*").withColumn("doc_id", F.col("doc_id") * 4 + F.col("n"))
    found = languages(more.drop("n"), usable()).join(more.select(F.col("doc_id").alias("id"), "lang"), "id")
    held = found.filter(F.crc32(F.col("id").cast("string")) % 3 == 1)
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_awkward_rows(documents, sample):
    rows = languages(documents, usable()).collect()
    assert len(rows) == len(sample)
    text = {i: t for i, t, *_ in sample if i != 5}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.id in text:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.id] or ""))


def test_nothing_to_learn_from(spark, no_documents):
    assert languages(no_documents, usable()).collect() == []
    docs = spark.createDataFrame([(1, "abc", None), (None, "def", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in languages(docs, usable()).collect()} == {("und", 0.0)}


def test_batched_windows_agree_with_single_rows():
    rng = np.random.RandomState(1)
    net = fresh(["a", "b", "c"], rng)
    net.bias += rng.randn(len(net.bias)).astype(np.float32)
    texts = [bytes(rng.randint(1, 256, n).astype(np.uint8)) for n in (1, 255, 256, 257, 512, 3000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    symbols, count = padded(data, offsets)
    together = Scorer(net).windows(symbols)
    at = 0
    for text, n in zip(texts, count):
        whole = np.full(n * 256 + 3, PAD)
        whole[: len(text)] = np.frombuffer(text, np.uint8)
        for k in range(n):
            conv = responses(net, whole[None, k * 256 : k * 256 + 259])
            alone = softmax(np.maximum(conv.max(1) + net.bias, 0) @ net.out + net.out_bias)
            assert np.allclose(alone[0], together[at], atol=1e-4)
            at += 1


def test_training_learns():
    rng = np.random.RandomState(2)
    rows = np.full((200, 259), PAD)
    labels = np.arange(200) % 2
    for i, label in enumerate(labels):
        rows[i, :100] = rng.choice([97, 98, 99], 100)
        if label:
            at = rng.randint(0, 90)
            rows[i, at : at + 3] = [100, 101, 102]
    scorer = Scorer(fit(rows, labels, ["no", "yes"]))
    out = np.concatenate([scorer.windows(r.astype(np.uint16)) for r in rows])
    assert (out.argmax(1) == labels).mean() > 0.95
