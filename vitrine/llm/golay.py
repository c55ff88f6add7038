"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of four
differing bits some pair of segments holds at most two, since the emptiest two
of three hold at most two thirds. Two 23-bit words that differ in at most two
bits have a word within one bit of both, so the sets {decode(v), decode(v with
one bit flipped)} of the perfect [23, 12, 7] Golay code share a codeword index.
A segment therefore has up to six indices, and a pair of segments the products
of theirs: keys of about 24 bits that every linked pair shares at least once.

Equal fingerprints are one row before any join. Buckets yield a spanning forest
of verified links (see ``buckets``), components follow from the forest.

Defined results: null and blank texts have fingerprint zero and link like any
other; repeated ids share the smallest component of their rows; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.buckets import by_key, forest, key_runs, run_bounds
from vitrine.llm.components import components
from vitrine.llm.texts import LOWER, signed, text_slices
from vitrine.session import settle

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator polynomial."""
    out = words.astype(np.uint32, copy=True)
    for bit in range(22, 10, -1):
        out ^= ((out >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return out


def error_patterns() -> np.ndarray:
    """The error of weight at most three behind each of the 2048 syndromes."""
    table = np.zeros(2048, np.uint32)
    for weight in range(1, 4):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.uint32)
        table[remainders(errors)] = errors
    return table


ERRORS = error_patterns()


def indices(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1) codeword indices of each word and of its one-bit neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    near = words.astype(np.uint32)[:, None] ^ flips
    return (near ^ ERRORS[remainders(near.ravel()).reshape(near.shape)]) >> np.uint32(11)


def fuzzy_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all its distinct keys."""
    parts = []
    for low, bits in SEGMENTS:
        words = (marks >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        found = np.sort(indices(words, bits), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(fresh)
        parts.append((row, found[row, col].astype(np.int64), fresh.sum(1)))
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (row_i, key_i, _n), (_row, key_j, n_j) = parts[i], parts[j]
        first_j = np.cumsum(n_j) - n_j
        times = n_j[row_i]
        left = np.repeat(np.arange(len(row_i)), times)
        within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        rows.append(row_i[left])
        keys.append((pair << 24) | (key_i[left] << 12) | key_j[first_j[row_i[left]] + within])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(words: list[bytes]) -> int:
    """Majority bits of the XXH64 hashes of all shingles of four words."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    size = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())),
        np.uint64,
        len(starts),
    )
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    majority = counts * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's columns but ``text``, and its fingerprint."""
    for rows, data, offsets in text_slices(batches, "text"):
        whole = LOWER[data].tobytes()
        ends = offsets.tolist()
        marks = np.array([simhash(whole[a:b].split()) for a, b in zip(ends, ends[1:])], np.uint64)
        kept = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in kept), pa.array(signed(marks))], [*kept, "mark"]
        )


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            marks = batch.column(0).slice(low, 4096).to_numpy(zero_copy_only=False)
            at, keys = fuzzy_keys(marks.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks[at])], ["key", "mark"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the verified links of every bucket."""
    for run in key_runs(batches, "key"):
        keys = run.column("key").to_numpy()
        marks = run.column("mark").to_numpy().view(np.uint64)
        bounds = run_bounds(keys)
        pairs: list[tuple[int, int]] = []
        # Buckets of two, nearly all of them, at once.
        two = bounds[:-1][np.diff(bounds) == 2]
        close = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= DISTANCE]
        pairs += zip(close.tolist(), (close + 1).tolist())
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low > 2:
                own = marks[low:high]

                def near(i: int, others: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                    return np.bitwise_count(own[others] ^ own[i]) <= DISTANCE

                pairs += ((low + i, low + j) for i, j in forest(high - low, near))
        if pairs:
            at = np.array(pairs)
            ends = np.sort(signed(marks[at]), axis=1)
            ends = np.unique(ends, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """Distinct (a, b) links that connect the distinct fingerprints in ``mark``."""
    keys = marks.mapInArrow(spread, "key long, mark long")
    return by_key(keys, "key").mapInArrow(linked, "a long, b long").distinct()


def named_marks(firsts: DataFrame) -> DataFrame:
    """Component of every distinct ``mark``, named by one of its marks."""
    parts = components(fingerprint_links(firsts.select("mark"))).withColumnRenamed("node", "mark")
    return firsts.join(parts, "mark", "left").withColumn("component", F.coalesce("component", "mark"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, component) of every document; a component is named by its smallest id."""
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    marked = settle(plain.mapInArrow(fingerprints, "id long, mark long"))
    # One row per distinct fingerprint; combined before the shuffle.
    names = settle(named_marks(marked.groupBy("mark").agg(F.min("id").alias("first"))))
    least = names.groupBy("component").agg(F.min("first").alias("component_id"))
    named = names.join(least, "component").select("mark", "component_id")
    return marked.join(named, "mark").select("id", "mark", F.col("component_id").alias("component"))


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of every component, all columns unchanged.

    Where rows repeat an id and text exactly, one of them stays.
    """
    key = F.xxhash64(F.col(id_column), F.col(text), F.octet_length(text))
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), key.alias("key"), F.col(text).cast("string").alias("text")
    )
    marked = plain.mapInArrow(fingerprints, "id long, key long, mark long")
    firsts = settle(marked.groupBy("mark").agg(F.min(F.struct("id", "key")).alias("first")))
    kept = (
        named_marks(firsts)
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("_kept"))
    )
    # The input's columns keep to a struct, whatever their names.
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    chosen = keyed.join(kept, keyed["key"] == kept["_kept"], "left_semi")
    return chosen.dropDuplicates(["key"]).select("row.*")
