"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line per group.

A line is normalised to its words (letters, digits and all non-ASCII; ASCII
lower case) joined by single spaces. Equal normal forms are one row before any
join, and of equal lines with at least one word one is kept at any length; only
the search for similar lines leaves out those of fewer than ``min_words`` words. Fingerprints within ``distance`` bits agree in at least
one of ``distance + 1`` blocks; a pair is looked at only in the first block in
which it agrees. Of a line only its fingerprint travels until a partner within
reach is known; then the text follows and the edit similarity, over words, is verified.
Buckets give spanning forests (see ``buckets``), groups follow from them.

The kept line of a group is its first in (id, line number) order. Defined
results: null texts stay null; rows that agree in id and text are one document
and keep the same lines; a text whose lines all go becomes empty; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.buckets import by_key, forest, key_runs, run_bounds
from vitrine.llm.components import components
from vitrine.llm.texts import LOWER, byte_class, mixed, prefix_sums, runs, signed, span_hashes, text_slices
from vitrine.session import settle

MIN_WORDS = 5
DISTANCE = 6
SIMILARITY = 0.8
BITMAP_BITS = 24
LINE_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
CHUNK = 512
WORD_BITS = np.uint64(55)
# Side of the blocks of comparisons, small enough for the processor's cache.
TILE = 256

PLACE = "id long, key long, line int, hash long, mark long, size int"


class Lines:
    """Lines of a slice with enough words: row, number in the row, hash, words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int) -> None:
        self.text = LOWER[data]
        self.words = runs(LINE_BYTES[data], offsets)
        breaks = np.flatnonzero(data == ord("\n"))
        # A line starts at each row's start and after each line break.
        has = np.diff(offsets) > 0
        starts = np.union1d(offsets[:-1][has], breaks[breaks + 1 < len(data)] + 1)
        row = np.searchsorted(offsets, starts, "right") - 1
        before = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[row])
        low = np.searchsorted(self.words.starts, starts)
        high = np.append(low[1:], len(self.words.starts))
        kept = high - low >= min_words
        self.low, self.high = low[kept], high[kept]
        self.row, self.number = row[kept], before[kept]
        self.word_hashes = span_hashes(prefix_sums(self.text), self.words.starts, self.words.ends)
        self.hashes = span_hashes(prefix_sums(self.word_hashes), self.low, self.high)

    def marks(self) -> np.ndarray:
        """Majority bits of the hashes of each line's distinct words.

        Repeats would let the commonest words of a language decide, and bring
        unrelated long lines together.
        """
        out = np.zeros(len(self.low), np.uint64)
        for a in range(0, len(self.low), CHUNK):
            low, high = self.low[a : a + CHUNK], self.high[a : a + CHUNK]
            own = np.concatenate([self.word_hashes[x:y] for x, y in zip(low.tolist(), high.tolist())])
            # The line in the high bits, so that one sort groups lines and brings equal words together.
            line = np.repeat(np.arange(len(low), dtype=np.uint64), high - low)
            keys = np.sort((line << WORD_BITS) | (own >> (np.uint64(64) - WORD_BITS)))
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
            size = np.bincount((keys >> WORD_BITS).astype(np.int64), minlength=len(low))
            own = mixed(keys & ((np.uint64(1) << WORD_BITS) - np.uint64(1)))
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int32)
            majority = counts * 2 > size[:, None]
            out[a : a + CHUNK] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def sizes(self) -> np.ndarray:
        """Words of each line."""
        return self.high - self.low

    def normal(self, whole: bytes, i: int) -> bytes:
        a, b = int(self.low[i]), int(self.high[i])
        spans = zip(self.words.starts[a:b].tolist(), self.words.ends[a:b].tolist())
        return b" ".join(whole[x:y] for x, y in spans)


def places(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            lines = Lines(data, offsets, min_words)
            row = pa.array(lines.row)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id").take(row),
                    rows.column("key").take(row),
                    pa.array(lines.number.astype(np.int32)),
                    pa.array(signed(lines.hashes)),
                    pa.array(signed(lines.marks())),
                    pa.array(lines.sizes().astype(np.int32)),
                ],
                ["id", "key", "line", "hash", "mark", "size"],
            )

    return scan


def block_edges(distance: int) -> list[int]:
    return [64 * i // (distance + 1) for i in range(distance + 2)]


def block_of(marks: np.ndarray, block: int, distance: int) -> np.ndarray:
    low, high = block_edges(distance)[block : block + 2]
    return (marks >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def dealt(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block of each line."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy().view(np.uint64)
            for block in range(distance + 1):
                keys = block_of(marks, block, distance).astype(np.int64) << 8 | block
                # One long that sorts by block, then by size.
                place = keys << 31 | batch.column("size").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), batch.column("mark"), batch.column("hash")], ["place", "mark", "hash"]
                )

    return deal


def with_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = batch.column("place").to_numpy() >> 31
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])


def within_reach(own: np.ndarray, other: np.ndarray, block: int, distance: int) -> np.ndarray:
    """Pairs of at most ``distance`` bits that no earlier block brings together."""
    apart = own ^ other
    near = np.bitwise_count(apart) <= distance
    if block and near.any():
        hits = np.nonzero(near)
        early = np.zeros(len(hits[0]), bool)
        for b in range(block):
            early |= block_of(apart[hits], b, distance) == 0
        near[hits] = ~early
    return near


def partnered(distance: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of a bucket that have a partner within reach there. Sorted by size, only sizes that
    can be similar are compared."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(with_blocks(batches), "block"):
            keys = run.column("block").to_numpy()
            sizes = run.column("place").to_numpy() & ((1 << 31) - 1)
            marks = run.column("mark").to_numpy().view(np.uint64)
            found = np.zeros(len(keys), bool)
            bounds = run_bounds(keys)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                block = int(keys[low]) & 255
                for a in range(low, high, TILE):
                    b = min(a + TILE, high)
                    most = sizes[b - 1] / similarity + 1e-9
                    end = low + int(np.searchsorted(sizes[low:high], most, "right"))
                    for c in range(a, end, 2 * TILE):
                        d = min(c + 2 * TILE, end)
                        near = within_reach(marks[a:b, None], marks[None, c:d], block, distance)
                        if c < b:
                            near &= np.arange(a, b)[:, None] < np.arange(c, d)
                        if near.any():
                            found[a:b] |= near.any(1)
                            found[c:d] |= near.any(0)
            rows = run.filter(pa.array(found)).select(["block", "mark", "hash"])
            yield from rows.to_batches()

    return find


def edit_distance(a: list[bytes], b: list[bytes]) -> int:
    """Levenshtein distance of two word lists, one column of the table per step as bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    full = (1 << len(a)) - 1
    where: dict[bytes, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, top = full, 0, len(a), 1 << (len(a) - 1)
    for c in b:
        match = where.get(c, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus = down | (full & ~(zero | up))
        minus = up & zero
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 | 1
        up = (minus << 1 | (full & ~(zero | plus))) & full
        down = plus & zero & full
    return score


def similar(a: list[bytes], b: list[bytes], similarity: float) -> bool:
    """Edit similarity, 1 - word edits / longer length, of at least ``similarity``."""
    allowed = (1 - similarity) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    shorter = min(len(a), len(b))
    head = next((i for i in range(shorter) if a[i] != b[i]), shorter)
    tail = next((i for i in range(shorter - head) if a[-1 - i] != b[-1 - i]), shorter - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    return max(len(a), len(b)) <= allowed or edit_distance(a, b) <= allowed


def verified(distance: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A spanning forest of the verified links of every bucket."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "block"):
            keys = run.column("block").to_numpy()
            marks = run.column("mark").to_numpy().view(np.uint64)
            hashes = run.column("hash").to_numpy()
            bounds = run_bounds(keys)
            pairs = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = marks[low:high]
                texts = [x.split(b" ") for x in run.column("normal").slice(low, high - low).to_pylist()]
                block = int(keys[low]) & 255

                def near(i: int, others: np.ndarray) -> np.ndarray:
                    out = within_reach(own[others], own[i], block, distance)  # noqa: B023
                    for k in np.flatnonzero(out).tolist():
                        out[k] = similar(texts[i], texts[others[k]], similarity)  # noqa: B023
                    return out

                pairs += ((low + i, low + j) for i, j in forest(high - low, near))
            if pairs:
                at = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at[:, 0]]), pa.array(hashes[at[:, 1]])], ["a", "b"])

    return link


def chosen_texts(
    bitmap: np.ndarray, min_words: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(hash, normal) of the lines whose hash is in the bitmap."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _rows, data, offsets in text_slices(batches, "text"):
            lines = Lines(data, offsets, min_words)
            bit = lines.hashes >> np.uint64(64 - BITMAP_BITS)
            hit = (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
            _hash, first = np.unique(lines.hashes, return_index=True)
            wanted = first[hit[first] > 0]
            whole = lines.text.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(lines.hashes[wanted])),
                    pa.array([lines.normal(whole, i) for i in wanted.tolist()], pa.binary()),
                ],
                ["hash", "normal"],
            )

    return scan


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size; at most 2^(bits - 6) words reach the driver."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    low = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")
    words = (
        hashes.select(F.shiftright(bit, 6).alias("word"), low.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def line_groups(keyed: DataFrame, distinct: DataFrame, min_words: int, distance: int, similarity: float) -> DataFrame:
    """(hash, group) of the distinct lines that are similar to another."""
    blocks = distinct.select("hash", "mark", "size").mapInArrow(
        dealt(distance), "place long, mark long, hash long"
    )
    near = settle(
        by_key(blocks, F.shiftright("place", 31), "place").mapInArrow(
            partnered(distance, similarity), "block long, mark long, hash long"
        )
    )
    # Only lines with a partner bring their text; the join decides, the bitmap saves.
    texts = (
        keyed.select("text")
        .mapInArrow(chosen_texts(bitmap_of(near.select("hash")), min_words), "hash long, normal binary")
        .groupBy("hash")
        .agg(F.min("normal").alias("normal"))
    )
    links = by_key(near.join(texts, "hash"), "block").mapInArrow(verified(distance, similarity), "a long, b long")
    return components(links.distinct()).select(F.col("node").alias("hash"), F.col("component").alias("group"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of the given numbers."""
    kept = F.filter(F.split(text, "\n", -1), lambda _x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    distance: int = DISTANCE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, gone): numbers of the lines to remove from each document that loses any."""
    keyed = docs.select(
        F.col(id_column).cast("long").alias("id"),
        document_key(id_column, text).alias("key"),
        F.col(text).cast("string").alias("text"),
    )
    lines = settle(keyed.mapInArrow(places(1), PLACE))
    distinct = settle(
        lines.groupBy("hash").agg(F.min("mark").alias("mark"), F.min("size").alias("size"), F.count("*").alias("n"))
    )
    comparable = distinct.filter(F.col("size") >= min_words)
    groups = settle(line_groups(keyed, comparable, min_words, distance, similarity))
    # Only lines that are repeated or grouped go on.
    named = (
        distinct.filter("n > 1")
        .select("hash")
        .join(groups, "hash", "full")
        .select("hash", F.coalesce("group", "hash").alias("name"))
    )
    found = settle(lines.join(named, "hash").select("name", "id", "key", "line"))
    # The first place of each group; combined before the shuffle. Written, so that
    # the join reads plain rows and a line of very many documents can be split.
    kept = settle(found.groupBy("name").agg(F.min(F.struct("id", "key", "line")).alias("kept")))
    extra = found.join(kept, "name").filter(
        ~F.struct("id", "key", "line").eqNullSafe(F.struct("kept.id", "kept.key", "kept.line"))
    )
    return extra.groupBy("key").agg(F.collect_set("line").alias("gone"))


def document_key(id_column: str, text: str) -> Column:
    return F.xxhash64(F.col(id_column), F.col(text), F.octet_length(text))


def dedupe_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """All documents with their repeated lines removed; ``_gone`` holds the lines' numbers."""
    gone = repeated_lines(docs, id_column, text, **options).withColumnRenamed("key", "_gone_key")
    plain = docs.drop("_gone", "_gone_key")
    return (
        plain.join(gone.withColumnRenamed("gone", "_gone"), document_key(id_column, text) == F.col("_gone_key"), "left")
        .withColumn(text, without_lines(F.col(text), F.col("_gone")))
        .drop("_gone_key")
    )
