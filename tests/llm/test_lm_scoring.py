from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm.lm_scoring import language_scores
from vitrine.llm.recurrent import HIDDEN, Model, Trainer, fresh, log_probabilities, score

from .conftest import tuples

def trains():
    return F.coalesce(F.crc32(F.col("id").cast("string")) % 7 != 2, F.lit(True))


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


@pytest.mark.parametrize("head", [8, 1 << 18])
def test_base_against_brute_force(documents, sample, head):
    counts: Counter = Counter()
    for i, text, *_ in sample:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(text))
    total, distinct = sum(counts.values()), len(counts)
    found = tuples(language_scores(documents, trains(), vocabulary=8, head=head), "id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(
        (
            i,
            len(words(t)),
            sum(counts[w] > 0 for w in words(t)),
            total,
            sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t)),
        )
        for i, t, *_ in sample
    )
    for a, b in zip(found, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and math.isfinite(a[5]) and a[5] <= 0


def test_better_than_frequencies_on_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = language_scores(docs, trains()).filter(~trains())
    assert held.filter("n_tokens > 50").agg(F.sum(F.col("score") - F.col("base_score"))).first()[0] > 0


def test_nothing_to_train_on(spark, no_documents):
    assert language_scores(no_documents, trains()).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for r in language_scores(docs, F.lit(False)).collect():
        assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(0, abs=1e-6)


@pytest.fixture(scope="module")
def model() -> Model:
    return fresh(np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5]), 12, 4)


def states_by_hand(model, tokens, end):
    h, out = np.zeros(HIDDEN), []
    sig = lambda x: 1 / (1 + np.exp(-x))
    for x in [end, *tokens[:-1]]:
        a, u = model.inputs[x].astype(float), h @ model.recurrent.astype(float)
        z, r = sig(a[:HIDDEN] + u[:HIDDEN]), sig(a[HIDDEN : 2 * HIDDEN] + u[HIDDEN : 2 * HIDDEN])
        n = np.tanh(a[2 * HIDDEN :] + r * u[2 * HIDDEN :])
        h = (1 - z) * n + z * h
        out.append(h)
    return np.array(out, np.float32)


def test_score_is_that_of_each_document_alone(model):
    rng = np.random.RandomState(4)
    documents = [rng.randint(0, 11, n) for n in (1, 200, 3, 77, 64, 65, 1, 500)]
    found = score(model, documents, 0)
    for d, total in zip(documents, found):
        by_hand = log_probabilities(model, states_by_hand(model, d, 0), d).sum()
        assert total == pytest.approx(by_hand, rel=1e-4)


def test_probabilities_sum_to_one(model):
    state = np.random.RandomState(1).randn(1, HIDDEN).astype(np.float32).repeat(11, 0)
    assert np.exp(log_probabilities(model, state, np.arange(11))).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_against_differences(model):
    """The recurrent gradient of one window, from the change of the loss."""
    import vitrine.llm.recurrent as recurrent

    rng = np.random.RandomState(6)
    inputs, targets = rng.randint(0, 11, (6, 5)), rng.randint(0, 11, (6, 5))
    starts = rng.rand(6, 5) < 0.2
    state = rng.randn(5, HIDDEN).astype(np.float32) * 0.1

    def loss(m):
        h = recurrent.forward(m, inputs, starts, state)
        return -log_probabilities(m, h.reshape(-1, HIDDEN), targets.ravel()).mean()

    seen = {}

    class Recording(Trainer):
        def step(self, which, gradient, rows=None):
            if which < 2:
                seen[which] = (gradient, rows)

    share, recurrent.LOSS_SHARE = recurrent.LOSS_SHARE, 1
    try:
        Recording(model, 1).window(inputs, targets, starts, state)
    finally:
        recurrent.LOSS_SHARE = share
    gradient = np.zeros(model.inputs.shape)
    gradient[seen[0][1]] = seen[0][0]
    for which, full in ((0, gradient), (1, seen[1][0])):
        for _ in range(12):
            at = tuple(rng.randint(0, n) for n in full.shape)
            two = []
            for sign in (1, -1):
                flat = [p.astype(np.float64).copy() for p in model.parameters()]
                flat[which][at] += sign * 1e-2
                two.append(loss(Model(*[p.astype(np.float32) for p in flat])))
            assert full[at] == pytest.approx((two[0] - two[1]) / 2e-2, abs=2e-4)


def test_training_learns_order():
    """Alternating words cannot be told apart by frequency."""
    m = fresh(np.array([100, 100, 20]), 1, 4)
    trainer = Trainer(m, 1)
    document = np.array([0, 1] * 20 + [2])
    for _ in range(60):
        tokens = np.tile(document, 40)
        first = np.zeros(len(tokens), bool)
        first[:: len(document)] = True
        trainer.train(tokens, first, 2)
    assert score(trainer.model, [document], 2)[0] / len(document) > -0.2


def test_every_token_is_a_target_of_the_loss():
    """Also those that fill no whole lane."""

    class Recording(Trainer):
        def output(self, states, targets):
            seen.update(targets.tolist())
            return super().output(states, targets)

    rng = np.random.RandomState(7)
    for n in (1, 639, 1281, 3 * 640 + 2):
        seen: Counter = Counter()
        tokens = rng.randint(0, 11, n)
        first = np.zeros(n, bool)
        first[0] = True
        trainer = Recording(fresh(np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5]), 12, 4), 1)
        trainer.train(tokens, first, 0)
        assert seen == Counter(tokens.tolist()) and trainer.tokens == n
        assert all(np.isfinite(p).all() for p in trainer.model.parameters())


def test_a_window_takes_its_exponentials_at_once(monkeypatch):
    """Every class of words had its own, so that small calls took most of the time."""
    import vitrine.llm.recurrent as recurrent

    calls = []
    before = recurrent.exponentials
    monkeypatch.setattr(recurrent, "exponentials", lambda logits: calls.append(len(logits)) or before(logits))
    m = fresh(np.arange(400, 0, -1), 12, 4)
    tokens = np.random.RandomState(8).randint(0, 401, 300)
    score(m, [tokens], 0)
    assert len(calls) == 2 * -(-300 // recurrent.SCORE_STEPS)
    calls.clear()
    Trainer(m, 1).output(np.zeros((300, HIDDEN), np.float32), tokens)
    assert len(calls) == 2


def test_output_gradients_against_differences(model):
    rng = np.random.RandomState(9)
    states, targets = rng.randn(30, HIDDEN).astype(np.float32), rng.randint(0, 11, 30)

    def loss(m, s):
        return -log_probabilities(m, s.astype(np.float32), targets).astype(np.float64).mean()

    seen = {}

    class Recording(Trainer):
        def step(self, which, gradient, rows=None):
            seen[which] = (gradient, rows)

    back = Recording(model, 1).output(states, targets)
    words = np.zeros(model.words.shape)
    words[seen[3][1]] = seen[3][0]
    for which, full in ((2, seen[2][0]), (3, words)):
        for _ in range(12):
            at = tuple(rng.randint(0, n) for n in full.shape)
            two = []
            for sign in (1, -1):
                flat = [p.astype(np.float64).copy() for p in model.parameters()]
                flat[which][at] += sign * 1e-2
                two.append(loss(Model(*[p.astype(np.float32) for p in flat]), states))
            assert full[at] == pytest.approx((two[0] - two[1]) / 2e-2, abs=2e-4)
    for _ in range(12):
        at = tuple(rng.randint(0, n) for n in states.shape)
        two = []
        for sign in (1, -1):
            moved = states.astype(np.float64).copy()
            moved[at] += sign * 1e-2
            two.append(loss(model, moved))
        assert back[at] == pytest.approx((two[0] - two[1]) / 2e-2, abs=2e-4)


def test_training_tasks_know_the_words_of_the_model_only(spark):
    from vitrine.llm.lm_scoring import corpus_of

    counts = spark.createDataFrame([("\n", 3), *((f"w{i}", 50 - i) for i in range(20))], "word string, n long")
    for vocabulary in (0, 1, 5, 21, 30):
        corpus = corpus_of(counts, 12, vocabulary)
        every = corpus.numbers()
        assert corpus.own_numbers() == {w: i for w, i in every.items() if i < corpus.vocabulary}
