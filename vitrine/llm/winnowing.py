"""Benchmark decontamination by winnowing.

Every window of consecutive words is represented by the smallest hash among
its k-grams, so two texts that share a window share its fingerprint wherever
the window stands. Fingerprints of documents and benchmark items are joined,
candidates are verified on the words of the window, and hits extend over all
words that a matching window covers. Nothing longer than a window is missed.

A fixed bitmap of the benchmark's fingerprints travels to the document scan and
drops windows that cannot match before the shuffle. Its size does not depend on
the data; with a very large benchmark it lets more candidates through and the
join does the work. The join's benchmark side has one row per distinct window,
so a passage shared by many documents meets a single row.

Defined results: null or blank texts have no words, no windows and no hits; an
item shorter than a window is one window of its own length; repeated item ids
count once, null ids not at all; repeated documents get one row each; an empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.frames import ROW, numbered
from vitrine.llm.texts import (
    LOWER,
    Words,
    byte_class,
    lists,
    mixed,
    prefix_sums,
    runs,
    signed,
    span_hashes,
    text_slices,
)
from vitrine.session import settle

WINDOW = 10
GRAM = 5
BITMAP_BITS = 22
ALNUM_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

HIT = "array<struct<size: int, at: long, mark: long, words: string>>"


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every window of ``size`` words."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(GRAM, size)
    rows = words.rows
    grams = np.arange(n - gram + 1)
    marks = span_hashes(prefix_sums(hashes), grams, grams + gram)
    starts = np.flatnonzero(rows[: n - size + 1] == rows[size - 1 :])
    least = marks[starts]
    for shift in range(1, size - gram + 1):
        least = np.minimum(least, marks[starts + shift])
    return starts, mixed(least ^ np.uint64(size))


def window_texts(data: np.ndarray, words: Words, starts: np.ndarray, size: int) -> list[str]:
    """Words of each window, joined by single spaces."""
    whole = data.tobytes()
    out = []
    for s in starts.tolist():
        spans = zip(words.starts[s : s + size].tolist(), words.ends[s : s + size].tolist())
        out.append(b" ".join(whole[a:b] for a, b in spans).decode("utf-8", "replace"))
    return out


def scanner(
    sizes: tuple[int, ...] | None, bitmap: np.ndarray | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of each row: of the given sizes if in the bitmap, or of the row's own size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            lowered = LOWER[data]
            words = runs(ALNUM_BYTES[data], offsets)
            hashes = span_hashes(prefix_sums(lowered), words.starts, words.ends)
            counts = words.counts
            n_words = np.minimum(counts, WINDOW)
            kept: list[tuple[np.ndarray, ...]] = []
            texts: list[str] = []
            for size in sizes if sizes is not None else np.unique(n_words[n_words > 0]).tolist():
                starts, marks = windows(words, hashes, size)
                owner = np.searchsorted(words.first, starts, "right") - 1
                if bitmap is None:
                    take = n_words[owner] == size
                else:
                    bit = marks >> np.uint64(64 - BITMAP_BITS)
                    take = (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                starts, marks, owner = starts[take], marks[take], owner[take]
                texts += window_texts(lowered, words, starts, size)
                kept.append((owner, np.full(len(starts), size), starts - words.first[owner], marks))
            owner, size, at, mark = (
                (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 4
            )
            order = np.argsort(owner, kind="stable")
            found = pa.StructArray.from_arrays(
                [
                    pa.array(size[order].astype(np.int32)),
                    pa.array(at[order].astype(np.int64)),
                    pa.array(signed(mark[order].astype(np.uint64))),
                    pc.take(pa.array(texts, pa.string()), pa.array(order)),
                ],
                ["size", "at", "mark", "words"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(counts.astype(np.int64)),
                    lists(found, np.bincount(owner.astype(np.int64), minlength=len(counts))),
                ],
                ["id", "n_words", "found"],
            )

    return scan


def item_windows(benchmark: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item, size, mark, words) of every distinct window of every item."""
    items = benchmark.select(
        F.col(id_column).cast("string").alias("id"), F.col(text).cast("string").alias("text")
    ).filter("id is not null")
    return (
        items.mapInArrow(scanner(None, None), f"id string, n_words long, found {HIT}")
        .select(F.col("id").alias("item"), F.explode("found").alias("f"))
        .select("item", "f.size", "f.mark", "f.words")
        .distinct()
    )


def bitmap_of(marks: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of fingerprints; at most 2^(bits - 6) words reach the driver."""
    bit = F.shiftrightunsigned("mark", 64 - BITMAP_BITS)
    words = (
        marks.select(
            F.shiftright(bit, 6).alias("word"),
            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Hits of every document: id, n_words, n_hit, items (sorted ids), spans.

    ``spans`` are the merged runs of hit words, ``[from, to)`` in word numbers.
    """
    windows_of = settle(item_windows(benchmark, item_column, item_text))
    # At most one size per length up to a whole window.
    sizes = tuple(sorted(r[0] for r in windows_of.select("size").distinct().collect()))
    bitmap = bitmap_of(windows_of)
    scanned = numbered(
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(scanner(sizes, bitmap), f"id long, n_words long, found {HIT}")
    )
    known = settle(
        windows_of.select("size", "mark", "words").distinct().withColumn("window", F.monotonically_increasing_id())
    )
    hits = (
        scanned.select(ROW, F.explode("found").alias("f"))
        .select(ROW, "f.size", "f.at", "f.mark", "f.words")
        .join(known, ["size", "mark", "words"])
        .groupBy(ROW)
        .agg(
            F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("to")))).alias("spans"),
            F.array_sort(F.collect_set("window")).alias("windows"),
        )
    )
    # Documents with the same set of windows, such as copies, resolve their items once.
    hits = settle(
        hits.select(
            ROW,
            merged_spans("spans").alias("spans"),
            "windows",
            F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256).alias("set"),
        )
    )
    owners = windows_of.join(known, ["size", "mark", "words"]).select("window", "item")
    sets = (
        hits.select("set", "windows")
        .dropDuplicates(["set"])
        .select("set", F.explode("windows").alias("window"))
        .join(owners, "window")
        .groupBy("set")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = hits.join(sets, "set").select(ROW, "spans", "items")
    length = "aggregate(spans, 0L, (n, s) -> n + s.to - s.at)"
    return (
        scanned.select(ROW, "id", "n_words")
        .join(found, ROW, "left")
        .select(
            "id",
            "n_words",
            F.coalesce(F.expr(length), F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<at: long, to: long>>")).alias("spans"),
        )
    )


def merged_spans(name: str):
    """Sorted spans joined where they touch or overlap."""
    return F.expr(
        f"""aggregate({name}, cast(array() as array<struct<at: bigint, to: bigint>>), (out, s) ->
            if(size(out) > 0 and element_at(out, -1).to >= s.at,
               concat(slice(out, 1, size(out) - 1),
                      array(struct(element_at(out, -1).at as at, greatest(element_at(out, -1).to, s.to) as to))),
               concat(out, array(struct(s.at as at, s.to as to)))))"""
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without a hit, all columns unchanged."""
    key = F.xxhash64(F.col(id_column), F.col(text), F.octet_length(text))
    marked = docs.select(key.alias("_key"), F.col(text).alias("text"))
    hit = (
        contamination(marked, benchmark, "_key", "text")
        .filter("n_hit > 0")
        .select(F.col("id").alias("_hit"))
        .distinct()
    )
    return docs.join(hit, key == hit["_hit"], "left_anti")
