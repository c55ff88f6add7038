"""Bytes inside long repeated strings, by prefix doubling over sampled positions.

Doubling over every byte position would sort the corpus many times over. Here a
window of ``length`` bytes is represented by the position, inside it, of its
smallest hashed gram: equal windows choose the same place, and a whole stretch
of neighbouring windows shares one position. Names stand for ranks: a name is a
64-bit hash of the string, equal for equal strings.

Round 1 counts the sampled positions by the name of their gram; a position whose
gram is unique takes its windows out. Among the others the pair (gram, all bytes
of the stretch's windows) decides: if it is repeated, all windows of the stretch
are. Only stretches at the ends of matches stay undecided. Round 2 does the same
for aligned blocks of 16 windows of those, with the bytes that all windows of
the block share in place of the gram. Round 3 takes every window of the blocks
that are left and sorts the pairs (name of the first half, name of the second
half), the doubling step from half the length to the whole: a window is repeated
if its pair is next to an equal one. In rounds 2 and 3 one stretch or block of
each repeated kind stands in for the others that undecided ones could meet.

A string that a third of all documents share is counted before any shuffle and its
rows are dealt out in joins; in round 3, where one window stands in for its equals,
sorted rows are compared with their neighbours only.

Defined results: null texts are empty; texts shorter than ``length`` keep every
byte; rows that agree in id and text match each other; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.buckets import by_key
from vitrine.llm.texts import mixed, prefix_sums, signed, span_hashes, text_slices
from vitrine.session import row_count_up_to, settle

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

LENGTH = 200
POSITION_BITS = np.uint64(30)

# Aligned windows of one block of round 2.
BLOCK = 16
# Documents known by key on every node; beyond that their texts meet the keys in a shuffle.
BROADCAST_KEYS = 1 << 18
LONGEST = 1 << 12

NAMED = "key long, gram long, whole long, place long"
SPANS = "key long, starts array<int>, stops array<int>"


def packed(start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Windows ``start`` to ``start + size`` sampled at ``anchor`` as one long; the low two bits are the state."""
    return (start << 26) | (size << 14) | ((anchor - start) << 2)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, anchor and state."""
    start = place >> 26
    return start, (place >> 14) & (LONGEST - 1), start + ((place >> 2) & (LONGEST - 1)), place & 3


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def stretches(length: int) -> Scan:
    """Stretches of windows that share their sampled position."""
    gram = max(1, length // 4)
    width = length - gram + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            if len(data) < length:
                continue
            prefix = prefix_sums(data)
            at = np.arange(len(data) - gram + 1)
            names = span_hashes(prefix, at, at + gram)
            marked = (names >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64)
            chosen = sliding_least(marked, width)
            sample = (chosen & np.uint64((1 << 30) - 1)).astype(np.int64)
            # Windows that lie inside one row.
            room = np.maximum(np.diff(offsets) - length + 1, 0)
            edge = np.zeros(len(data) + 1, np.int32)
            has = room > 0
            np.add.at(edge, offsets[:-1][has], 1)
            np.add.at(edge, (offsets[:-1] + room)[has], -1)
            valid = np.flatnonzero(np.cumsum(edge[: len(chosen)]) > 0)
            if not len(valid):
                continue
            own = sample[valid]
            new = np.ones(len(valid), bool)
            new[1:] = (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)
            first = np.flatnonzero(new)
            start = valid[first]
            stop = valid[np.append(first[1:], len(valid)) - 1] + 1
            row = np.searchsorted(offsets, start, "right") - 1
            whole = span_hashes(prefix, start, stop - 1 + length)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row)),
                    pa.array(signed(names[own[first]])),
                    pa.array(signed(whole)),
                    pa.array(packed(start - offsets[row], stop - start, own[first] - offsets[row])),
                ],
                ["key", "gram", "whole", "place"],
            )

    return scan


def beside(
    batches: Iterator[pa.RecordBatch], *keys: str
) -> Iterator[tuple[pa.Table, list[np.ndarray], list[np.ndarray]]]:
    """Sorted rows with, for each prefix of ``keys``, whether the row before and after agree on it."""
    held: pa.Table | None = None
    known = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if rows.num_rows - known > 1:
            before, after = agreement(rows, keys)
            last = rows.num_rows - 1
            yield rows.slice(known, last - known), [b[known:last] for b in before], [a[known:last] for a in after]
            held, known = rows.slice(max(last - 1, 0)), min(last, 1)
        else:
            held = rows
    if held is not None:
        before, after = agreement(held, keys)
        yield held.slice(known), [b[known:] for b in before], [a[known:] for a in after]


def agreement(rows: pa.Table, keys: tuple[str, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    same = np.ones(rows.num_rows - 1, bool)
    before, after = [], []
    for key in keys:
        values = rows.column(key).to_numpy()
        same = same & (values[1:] == values[:-1])
        before.append(np.concatenate([[False], same]))
        after.append(np.concatenate([same, [False]]))
    return before, after


def places_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place of every entry of the rows' ``places``."""
    places = rows.column("places")
    counts = np.diff(places.offsets.to_numpy())
    return np.repeat(np.arange(len(counts)), counts), places.flatten().to_numpy()


def counted(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its numbers ``first`` to ``first + size``: entry and number."""
    entry = np.repeat(np.arange(len(size)), size)
    return entry, first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)


def aligned_blocks(length: int) -> Scan:
    """Blocks of 16 windows, aligned to the sampled position, of the undecided and shown stretches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            row, place = places_of(rows)
            start, size, anchor, _state = unpacked(place)
            nearest, farthest = anchor - (start + size - 1), anchor - start
            entry, block = counted(nearest // BLOCK, farthest // BLOCK - nearest // BLOCK + 1)
            row, start, stop, anchor = row[entry], start[entry], (start + size)[entry], anchor[entry]
            low, high = anchor - block * BLOCK - BLOCK + 1, anchor - block * BLOCK + 1
            own_start, own_stop = np.maximum(low, start), np.minimum(high, stop)
            prefix = prefix_sums(data)
            base = offsets[:-1][row]
            core = span_hashes(prefix, base + high - 1, base + low + length)
            # A block cut off by its stretch has no partner as a whole.
            full = (low >= start) & (high <= stop)
            whole = mixed(mixed(rows.column("key").to_numpy()[row].view(np.uint64)) ^ own_start.astype(np.uint64))
            whole[full] = span_hashes(prefix, (base + low)[full], (base + high - 1 + length)[full])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key").take(pa.array(row)),
                    pa.array(signed(core)),
                    pa.array(signed(whole)),
                    pa.array(packed(own_start, own_stop - own_start, anchor)),
                ],
                ["key", "gram", "whole", "place"],
            )

    return scan


def window_pairs(length: int) -> Scan:
    """Names of both halves of every window of the undecided and shown blocks."""
    half = length // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", 1 << 19):
            prefix = prefix_sums(data)
            row, place = places_of(rows)
            start, size, _anchor, state = unpacked(place)
            entry, at = counted(start, size)
            begin = at + offsets[:-1][row[entry]]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key").take(pa.array(row[entry])),
                    pa.array(at << 2 | state[entry]),
                    pa.array(signed(span_hashes(prefix, begin, begin + half))),
                    pa.array(signed(span_hashes(prefix, begin + half, begin + length))),
                ],
                ["key", "place", "left", "right"],
            )

    return scan


def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Undecided windows whose pair of names stands next to an equal one."""
    for rows, before, after in beside(batches, "left", "right"):
        place = rows.column("place").to_numpy()
        kept = (before[1] | after[1]) & (place & 3 == 0)
        yield pa.RecordBatch.from_arrays(
            [rows.column("key").filter(pa.array(kept)).combine_chunks(), pa.array(place[kept] >> 2)], ["key", "at"]
        )


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by key and start, merged where they touch; one row per key."""
    key: int | None = None
    starts: list[int] = []
    stops: list[int] = []

    def done() -> pa.RecordBatch:
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([starts], kind), pa.array([stops], kind)],
            ["key", "starts", "stops"],
        )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, start, stop = (batch.column(c).to_numpy() for c in ("key", "start", "stop"))
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if key is not None and key != keys[low]:
                yield done()
                starts, stops = [], []
            key = int(keys[low])
            own, reach = start[low:high], np.maximum.accumulate(stop[low:high])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] > reach[:-1]
            begin = np.flatnonzero(new)
            ends = reach[np.append(begin[1:], len(own)) - 1].tolist()
            for a, b in zip(own[begin].tolist(), ends):
                if stops and a <= stops[-1]:
                    stops[-1] = max(stops[-1], b)
                else:
                    starts.append(a)
                    stops.append(b)
    if key is not None:
        yield done()


def cut_text(text: bytes, starts: list[int], stops: list[int]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for a, b in zip(starts, stops):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def classified(named: DataFrame) -> DataFrame:
    """Rows whose gram is repeated, with a state: 0 undecided, 1 the first of those
    with the same bytes, 2 the others of them.

    Grams and kinds are counted with map-side combine; rows meet the counts in joins,
    where the many rows of one passage can be split over tasks. The counts are written
    first: a join that also aggregates is not split.
    """
    named = settle(named)
    grams = settle(named.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    repeated = settle(named.join(grams, "gram", "left_semi"))
    own = F.struct("key", "place")
    kinds = settle(
        repeated.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(own).alias("first")).filter("n > 1")
    )
    state = F.when(F.col("n").isNull(), 0).when(own == F.col("first"), 1).otherwise(2)
    return repeated.join(kinds, ["gram", "whole"], "left").select(
        "key", "gram", F.col("place").bitwiseOR(state.cast("long")).alias("place")
    )


def among(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyed`` rows whose key is in the distinct ``keys``, and the others.

    Up to a counted number of keys they are sent to the rows, which then need no
    shuffle; more of them meet the rows in one.
    """
    if row_count_up_to(keys, BROADCAST_KEYS) <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return keyed.join(keys, "key", "left_semi"), keyed.join(keys, "key", "left_anti")


def named_again(keyed: DataFrame, found: DataFrame, scan: Scan, schema: str) -> DataFrame:
    """``scan`` over the texts of what is undecided in ``found`` and what is shown to it."""
    undecided = found.filter("place & 3 = 0")
    grams = undecided.select("gram").distinct()
    shown = found.filter("place & 3 = 1").join(grams, "gram", "left_semi")
    places = settle(
        undecided.select("key", "place")
        .unionByName(shown.select("key", "place"))
        .groupBy("key")
        .agg(F.collect_set("place").alias("places"))
    )
    texts, _rest = among(keyed, places.select("key"))
    return texts.join(places, "key").mapInArrow(scan, schema)


def decided_spans(found: DataFrame, length: int) -> DataFrame:
    """(key, start, stop) of the bytes of the windows known to be repeated."""
    start = F.shiftright("place", 26)
    size = F.shiftright("place", 14).bitwiseAND(F.lit(LONGEST - 1))
    return found.filter("place & 3 > 0").select(
        "key", start.cast("int").alias("start"), (start + size - 1 + length).cast("int").alias("stop")
    )


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, starts, stops): merged byte spans of repeated strings of (key, text) rows."""
    if not BLOCK < length < LONGEST:
        raise ValueError(f"length must lie between {BLOCK} and {LONGEST}, not {length}")
    sampled = keyed.mapInArrow(stretches(length), NAMED)
    first = settle(classified(sampled))
    blocks = named_again(keyed, first, aligned_blocks(length), NAMED)
    second = settle(classified(blocks))
    windows = named_again(keyed, second, window_pairs(length), "key long, place long, left long, right long")
    single = by_key(windows, "left", "right").mapInArrow(repeated_windows, "key long, at long")
    at = F.col("at").cast("int")
    spans = (
        decided_spans(first, length)
        .unionByName(decided_spans(second, length))
        .unionByName(single.select("key", at.alias("start"), (at + length).alias("stop")))
    )
    return by_key(spans, "key", "start").mapInArrow(merged, SPANS)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "starts", "stops"))):
            raw = (text or "").encode()
            starts, stops = starts or [], stops or []
            kept = cut_text(raw, starts, stops)
            out.append((key, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([r[i] for r in out], pa.int64()) for i in range(4)),
                pa.array([r[4] for r in out], pa.string()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def with_spans(docs: DataFrame, id_column: str, text: str, length: int) -> DataFrame:
    """(id, text, starts, stops) of every row; no spans is null."""
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("key", F.xxhash64("id", "text", F.octet_length("text")))
    spans = settle(repeated_spans(plain.select("key", "text"), length))
    cut, whole = among(plain, spans.select("key"))
    none = F.lit(None).cast("array<int>")
    return (
        cut.join(spans, "key")
        .select("id", "text", "starts", "stops")
        .unionByName(whole.select("id", "text", none.alias("starts"), none.alias("stops")))
    )


def repeat_digests(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """Size, removed bytes, spans and digest of what is left of every document."""
    return with_spans(docs, id_column, text, length).mapInArrow(
        digests, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
