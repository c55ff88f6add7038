"""Packing token sequences by matching large items and best-fitting small ones.

Documents become token ids in Python workers, word by word through a bounded
cache. Lengths are whole numbers up to the capacity, so the plan is made over
the histogram of lengths, whose size the capacity bounds whatever the corpus
holds: pieces above a third of the capacity are matched greedily, the longest
with the longest that still fits, at most two a sequence; smaller pieces go,
longest first, into the tightest gap that takes them, then into new sequences.
Each step of the plan says that a run of pieces of one length goes to a run of
sequences at one offset. Pieces find their step by their place in the order of
lengths, which is a range-partitioned sort of slim rows.

Defined results: a null text is empty and is its end token alone; rows agreeing
in id are packed as documents of their own; a document longer than the capacity
is cut into pieces of the capacity and a last one; without documents there are
no sequences. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordinals import with_ordinals
from vitrine.session import settle

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
# Words are cut at these four only; any further blank inside a word is left to the tokenizer.
WORD = re.compile(r"[^ \t\n\r]+")
# Marks that end words. Behind a letter or digit they are tokens of their own.
MARKS = ".,;:!?)\"#$%&*"
# The last letter whose lower case and composed form are beyond doubt.
LATIN = "\u024f"
WORDS_AT_ONCE = 1 << 16
LONG_TEXT = 1 << 20
CACHED_WORDS = 1 << 20
CACHED_BYTES = 1 << 25
ID_TYPE = "<u4"
ROWS_OUT = 4096

PIECES = "id {key}, piece int, start long, length long, ids_crc32 long, ids binary"


class Encoder:
    """Little-endian 32-bit ids of words.

    The vocabulary drops white space before its merges and joins nothing across
    it, so the ids of a text are those of its words. Words seen lately are kept
    in two generations of bounded size.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # What the file's rules do to lower-case Latin letters, namely nothing but to write them as bytes.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # ASCII letters are their own bytes.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """A table of ids that holds the given words."""
        if len(self.known) > CACHED_WORDS or self.held > CACHED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        new, stems, asked = [], [], set()
        for word in set(words):
            if word in known:
                continue
            if word in older:
                known[word] = older[word]
                continue
            # A word with marks behind it is that word and the marks, which are known sooner.
            stem = word.rstrip(MARKS)
            last = stem[-1:]
            if not last.isalnum() or not (last.isascii() or last.islower() and last <= LATIN):
                stem = word
            elif stem.isascii() and stem.isalnum():
                stem = stem.lower()
            new.append(word)
            stems.append(stem)
            asked.add(stem)
            if len(stem) < len(word):
                asked.add(word[len(stem) :])
        plain, letters, others = [], [], []
        for word in asked:
            if word not in known:
                self.held += len(word)
                if not (word.isalpha() and word.islower() and max(word) <= LATIN):
                    others.append(word)
                else:
                    (plain if word.isascii() else letters).append(word)
        for tokenizer, unknown in ((self.plain, plain), (self.letters, letters), (self.tokenizer, others)):
            for word, found in zip(unknown, tokenizer.encode_batch_fast(unknown, add_special_tokens=False)):
                known[word] = pack_ids(found.ids)
        for word, stem in zip(new, stems):
            if len(stem) < len(word):
                known[word] = known[stem] + known[word[len(stem) :]]
            else:
                known[word] = known[stem]
        return known

    def texts(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """Ids of each text in stretches; short texts are looked up together."""
        held: list[list[str]] = []
        total = 0
        for text in texts:
            if len(text) > LONG_TEXT:
                yield from self._held(held)
                held, total = [], 0
                yield self._stretches(text)
                continue
            held.append(WORD.findall(text))
            total += len(held[-1])
            if total > WORDS_AT_ONCE:
                yield from self._held(held)
                held, total = [], 0
        yield from self._held(held)

    def _held(self, held: list[list[str]]) -> Iterator[Iterator[bytes]]:
        ids = self.learn(chain.from_iterable(held))
        for words in held:
            yield iter([b"".join([ids[w] for w in words])])

    def _stretches(self, text: str) -> Iterator[bytes]:
        found = (m.group() for m in WORD.finditer(text))
        while words := list(islice(found, WORDS_AT_ONCE)):
            ids = self.learn(words)
            yield b"".join([ids[w] for w in words])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, with the words that earlier tasks have seen."""
    return Encoder(path)


def document_pieces(ids: Iterator[bytes], capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of one document, its end token last."""
    width = np.dtype(ID_TYPE).itemsize
    end = pack_ids([END])
    held = b""
    piece = 0
    for more in ids:
        held += more
        # A full piece waits for what follows it, if only the end token.
        while len(held) > capacity * width:
            yield piece, piece * capacity, held[: capacity * width]
            held = held[capacity * width :]
            piece += 1
    held += end
    for low in range(0, len(held), capacity * width):
        yield piece, piece * capacity, held[low : low + capacity * width]
        piece += 1


def pieces(
    documents: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, ids)`` of all documents; ids are little-endian 32-bit numbers.

    ``vocabulary`` is a tokenizer file that every worker can open; None stands
    for the installed public one. Without ``keep_ids`` ids are null.
    """
    source = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    width = np.dtype(ID_TYPE).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is None:
            import public_tokenizers

            encode = encoder(public_tokenizers.path(VOCABULARY))
        else:
            encode = encoder(vocabulary)
        for batch in batches:
            names, rows = batch.column(0), []
            owner: list[int] = []

            def written() -> pa.RecordBatch:
                piece, start, ids = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(owner)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(i) // width for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                        pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"],
                )

            bodies = (batch.column(1)[row].as_py() or "" for row in range(batch.num_rows))
            for row, ids in enumerate(encode.texts(bodies)):
                for found in document_pieces(ids, capacity):
                    owner.append(row)
                    rows.append(found)
                    if len(rows) == ROWS_OUT:
                        yield written()
                        owner, rows = [], []
            if rows:
                yield written()

    return source.mapInArrow(run, PIECES.format(key=source.schema["id"].dataType.simpleString()))


class Gaps:
    """Runs of sequences by the gap they have left."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if not gap:
            return
        if gap not in self.runs:
            insort(self.sizes, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, count))

    def tightest(self, size: int) -> int | None:
        """The smallest gap of at least ``size``."""
        place = bisect_left(self.sizes, size)
        return self.sizes[place] if place < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences with this gap: its first one and their number."""
        first, count = self.runs[gap].pop()
        if count > most:
            self.runs[gap].append((first + most, count - most))
            count = most
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.remove(gap)
        return first, count


class Plan:
    """Steps (place of the first piece, number, first sequence, offset) over pieces in falling length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.steps: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self.left = dict(sorted(counts.items(), reverse=True))
        self.place: dict[int, int] = {}
        before = 0
        for size, count in self.left.items():
            self.place[size] = before
            before += count
        self.gaps = Gaps()
        self._match([s for s in self.left if 3 * s > capacity])
        for size in [s for s in self.left if 3 * s <= capacity]:
            self._best_fit(size)

    def _put(self, size: int, count: int, first: int, offset: int) -> None:
        """``count`` pieces of ``size``, one to each sequence from ``first`` on."""
        self.steps.append((self.place[size], count, first, offset))
        self.place[size] += count
        self.left[size] -= count

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _match(self, large: list[int]) -> None:
        """Longest with the longest that fits, at most two a sequence; ``large`` falls."""
        for size in large:
            while self.left[size]:
                room = self.capacity - size
                other = next((s for s in large if s <= min(room, size) and self.left[s]), None)
                n = self.left[size]
                if other == size and n > 1:
                    n //= 2
                elif other is None or other == size:
                    other = None
                else:
                    n = min(n, self.left[other])
                first = self._open(n)
                self._put(size, n, first, 0)
                if other is not None:
                    self._put(other, n, first, size)
                self.gaps.add(room - (other or 0), first, n)

    def _best_fit(self, size: int) -> None:
        while self.left[size]:
            gap = self.gaps.tightest(size)
            if gap is not None:
                first, n = self.gaps.take(gap, self.left[size])
                self._put(size, n, first, self.capacity - gap)
                self.gaps.add(gap - size, first, n)
                continue
            # None has room: whole new sequences of this length, then one for what is left.
            each = min(self.capacity // size, self.left[size])
            n = self.left[size] // each
            first = self._open(n)
            for i in range(each):
                self._put(size, n, first, i * size)
            self.gaps.add(self.capacity - each * size, first, n)

    def table(self) -> np.ndarray:
        """Steps by place, as columns."""
        steps = np.asarray(self.steps, np.int64).reshape(-1, 4)
        return steps[np.argsort(steps[:, 0])].T


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, ``capacity`` rows at most, comes to the
    driver; the plan made of it goes out with the tasks.
    """
    # Written first, as the sort looks at its input twice.
    cut = settle(cut)
    # Ids that agree are told apart by their place in the sort's written copy.
    order = [F.col("length").desc(), F.col("id"), F.col("piece"), F.col("ids_crc32")]
    placed = with_ordinals(cut, order, "place")
    counts = {r["length"]: r["count"] for r in placed.groupBy("length").count().collect()}
    plan = Plan(counts, capacity).table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, _number, sequence, offset = plan
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(batch.schema.get_field_index("place")).to_numpy()
            step = np.searchsorted(begin, place, "right") - 1
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "place"]
            names = [n for n in batch.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[step] + place - begin[step]), pa.array(offset[step])],
                names=[*names, "sequence_id", "offset"],
            )

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return placed.mapInArrow(run, f"{held}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, tokens, ids)``: the packed sequences, ids as little-endian 32-bit numbers.

    A sequence is bounded by the capacity, so a group is too.
    """
    # Binary values are joined as hex text: a list of them has no join of its own.
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.unhex(F.array_join(parts["ids"], "")).alias("ids")
    )
