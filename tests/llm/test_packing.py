from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm.packing import CAPACITY, END, Encoder, Plan, document_pieces, pack, pieces, sequences

AWKWARD = [
    "Don't STOP — naïve Straße, 12345 €uro and　wide\x0bblanks\x1c here",
    "été ́x ΑΣ ΑΣ. İstanbul 'S 'll\t\n\r<|endoftext|> a<|startoftext|>b",
    "日本語のテキスト 🙂🙂 #$%& ___",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [END]


def check_packing(rows, bodies, capacity):
    """Pieces restore every document, sequences have no gaps and hold no more than the capacity."""
    wanted = []
    for name, ids in bodies:
        for piece, low in enumerate(range(0, len(ids), capacity)):
            wanted.append((name, piece, low, ids[low : low + capacity]))
    found = []
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert (len(ids), zlib.crc32(bytes(r["ids"]))) == (r["length"], r["ids_crc32"])
        found.append((r["id"], r["piece"], r["start"], ids))
    assert sorted(found) == sorted(wanted)
    for held in by_sequence.values():
        place = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= capacity
        assert sum(3 * r["length"] > capacity for r in held) <= 2
    return len(by_sequence)


def test_whole_texts(spark, documents, sample, tokenizer):
    rows = pack(pieces(documents)).collect()
    bodies = [(i, whole_ids(tokenizer, text)) for i, text, _l, _s in sample]
    n = check_packing(rows, bodies, CAPACITY)
    assert n == -(-sum(len(ids) for _i, ids in bodies) // CAPACITY)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_small_capacities(spark, sample, documents, tokenizer, capacity):
    rows = pack(pieces(documents, capacity=capacity), capacity).collect()
    check_packing(rows, [(i, whole_ids(tokenizer, t)) for i, t, _l, _s in sample], capacity)


def test_awkward_and_long_texts(spark, tokenizer):
    rng = random.Random(4)
    long = "".join(rng.choice(AWKWARD) + rng.choice(" \n\t") for _ in range(90_000))
    texts = [*AWKWARD, "x" * 300_000, long, *AWKWARD]
    assert len(long.encode()) > 5_000_000
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in enumerate(texts)], "doc_id long, text string, place string, length string")
    rows = pack(pieces(df)).collect()
    check_packing(rows, [(i, whole_ids(tokenizer, t)) for i, t in enumerate(texts)], CAPACITY)


def test_without_documents_and_ids(spark, no_documents, documents):
    assert pack(pieces(no_documents)).collect() == []
    assert {r["ids"] for r in pieces(documents, keep_ids=False).collect()} == {None}


def test_sequences_hold_their_pieces(spark, documents):
    packed = pack(pieces(documents)).cache()
    rows = packed.collect()
    for r in sequences(packed).collect():
        held = sorted((p for p in rows if p["sequence_id"] == r["sequence_id"]), key=lambda p: p["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(p["ids"]) for p in held)
        assert r["tokens"] * 4 == len(bytes(r["ids"]))


def test_every_letter_and_mark(tokenizer):
    """Words of every character up to the Greek ones, beside letters, marks and accents."""
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [a + chr(c) + b for c in range(33, 0x3FF) for a in ("", "ab", "É") for b in ("", "x", ".", "!?'s", ")#", "\"$", "\u0301", "B,")]
    found = encode.learn(words)
    for word in words:
        assert found[word] == np.asarray(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 9])
def test_pieces_end_with_the_end_token(n):
    ids = np.arange(10, 10 + n, dtype="<u4").tobytes()
    found = [np.frombuffer(p, "<u4").tolist() for _i, _s, p in document_pieces(iter([ids]), 4)]
    assert sum(found, []) == [*range(10, 10 + n), END]
    assert all(len(p) == 4 for p in found[:-1]) and found[-1]


@pytest.mark.parametrize("seed", range(30))
def test_plan_against_one_piece_at_a_time(seed):
    """The plan over counts packs as tightly as best fit over single pieces, largest first."""
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    sizes = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randrange(1, 400))]
    counts = {s: sizes.count(s) for s in sizes}
    plan = Plan(counts, capacity)
    ordered = sorted(sizes, reverse=True)
    placed = {}
    for place, n, first, offset in plan.steps:
        for i in range(n):
            assert place + i not in placed
            placed[place + i] = (first + i, offset)
    assert sorted(placed) == list(range(len(sizes)))
    room = {}
    for place, (sequence, offset) in placed.items():
        room.setdefault(sequence, []).append((offset, ordered[place]))
    for held in room.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= capacity
    gaps = []
    for size in ordered:
        fits = [i for i, g in enumerate(gaps) if g >= size]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= size
        else:
            gaps.append(capacity - size)
    assert plan.sequences == len(room) <= len(gaps)
