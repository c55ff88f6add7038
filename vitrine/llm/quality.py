"""Cross-document line frequency: boilerplate lines of a host and depleted documents.

A line is normalised (ASCII lower case, digits to 0, blanks collapsed) and
hashed. Within a host it is boilerplate when enough distinct documents hold it.
Copies count as one document: exact copies, up to case and digits, have the same
fingerprint, and near copies the same component of ``golay``'s links (at most
four of 64 bits apart). So copies neither make each other's lines boilerplate
nor hide a template that many distinct documents hold. Only fingerprints of
documents with a line above the absolute limit are linked.

Defined results: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows get one result each; an empty table gives
no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.frames import ROW, numbered
from vitrine.llm.fuzzy_lines import without_lines
from vitrine.llm.golay import named_marks, simhash
from vitrine.llm.texts import (
    LOWER,
    WORD_BYTES,
    byte_class,
    lists,
    mixed,
    per_row,
    prefix_sums,
    runs,
    signed,
    span_hashes,
    text_slices,
)
from vitrine.session import settle

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIGITS = byte_class((0x30, 0x39))
NORMAL = LOWER.copy()
NORMAL[DIGITS] = ord("0")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MIN_DOCUMENTS = 10
HOST_PERMILLE = 1
MIN_LEFT_PERCENT = 20
MIN_LOST_PERCENT = 50

SCHEMA = (
    "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, mark long, lines array<struct<line: long, words: long, numbers: array<int>>>"
)


def repeated_words(words: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each row inside a window of eight words that the row holds twice."""
    n = len(words)
    covered = np.zeros(n, bool)
    if n >= WINDOW:
        prefix = prefix_sums(words)
        start = np.flatnonzero(rows[: n - WINDOW + 1] == rows[WINDOW - 1 :])
        window = span_hashes(prefix, start, start + WINDOW)
        _u, inverse, counts = np.unique(
            mixed(window ^ mixed(rows[start].astype(np.uint64))),
            return_inverse=True,
            return_counts=True,
        )
        found = start[counts[inverse] > 1]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
    return per_row(covered, first)


def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and hashed lines of every text."""
    for rows, data, offsets in text_slices(batches, "text"):
        words = runs(WORD_BYTES[data], offsets)
        owner = words.rows
        raw = span_hashes(prefix_sums(data), words.starts, words.ends)
        continues = (data & 0xC0) == 0x80
        in_word = WORD_BYTES[data] & ~continues

        # Lines, and the words that lie in each.
        lines = runs(data != ord("\n"), offsets)
        low = np.searchsorted(words.starts, lines.starts)
        high = np.searchsorted(words.starts, lines.ends)
        held = high > low
        line_row = lines.rows[held]
        low, high = low[held], high[held]
        exact = span_hashes(prefix_sums(data), lines.starts[held], lines.ends[held])
        keyed = mixed(exact ^ mixed(line_row.astype(np.uint64)))
        order = np.argsort(keyed, kind="stable")
        again = np.zeros(len(keyed), bool)
        again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
        row_lines = np.searchsorted(line_row, np.arange(len(offsets)))

        plain = NORMAL[data]
        whole, ends = plain.tobytes(), offsets.tolist()
        marks = np.array([simhash(whole[a:b].split()) for a, b in zip(ends, ends[1:])], np.uint64)
        normal = span_hashes(prefix_sums(plain), words.starts, words.ends)
        line = span_hashes(prefix_sums(normal), low, high)
        breaks = np.flatnonzero(data == ord("\n"))
        starts = lines.starts[held]
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[line_row])
        kept, n_words, numbers, counts = distinct_lines(line, line_row, high - low, number, len(offsets) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                rows.column(1),
                pa.array(words.counts),
                pa.array(per_row(in_word, offsets)),
                pa.array(per_row(SYMBOLS[data], offsets)),
                pa.array(per_row(again, row_lines)),
                pa.array(repeated_words(raw, words.first, owner)),
                pa.array(signed(marks)),
                lists(
                    pa.StructArray.from_arrays(
                        [pa.array(signed(kept)), pa.array(n_words), numbers], ["line", "words", "numbers"]
                    ),
                    counts,
                ),
            ],
            ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mark", "lines"],
        )


def distinct_lines(
    line: np.ndarray, row: np.ndarray, words: np.ndarray, number: np.ndarray, n_rows: int
) -> tuple[np.ndarray, np.ndarray, pa.ListArray, np.ndarray]:
    """Distinct lines of each row: hash, words in all its copies, their numbers, and how many a row has."""
    order = np.lexsort((line, row))
    line, row, words = line[order], row[order], words[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(words, at) if len(at) else words
    numbers = lists(number[order].astype(np.int32), np.diff(np.append(at, len(line))))
    line, row = line[at], row[at]
    counts = np.bincount(row, minlength=n_rows)
    return line, total.astype(np.int64), numbers, counts


def measured(docs: DataFrame, id_column: str, text: str, host: str) -> DataFrame:
    """One numbered row per document with its counts and hashed lines."""
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(host).cast("string").alias("host"),
        F.col(text).cast("string").alias("text"),
    )
    return numbered(plain.mapInArrow(measures, SCHEMA))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )


def boilerplate(docs: DataFrame, min_documents: int, host_permille: int) -> tuple[DataFrame, DataFrame]:
    """(host, line) pairs above their host's limit, and (row, host, line, words,
    numbers) of the lines that could be.

    Counts combine before the shuffle, so a line or a host that holds a large
    share of all rows meets in a task as one row per map task.
    """
    lines = docs.select(ROW, "host", "mark", F.explode("lines").alias("l")).select(
        ROW, "host", "mark", "l.line", "l.words", "l.numbers"
    )
    # No line has more components than fingerprints, so this loses none.
    likely = settle(
        lines.groupBy("host", "line", "mark")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_documents)
        .select("host", "line")
    )
    held = settle(
        lines.alias("a")
        .join(likely.alias("b"), F.expr("a.line = b.line and a.host <=> b.host"))
        .select(f"a.{ROW}", "a.host", "a.mark", "a.line", "a.words", "a.numbers")
    )
    names = settle(named_marks(held.select("mark").distinct()))
    # Exact copies are one row before they meet their component.
    counted = (
        held.select("host", "line", "mark")
        .distinct()
        .join(names, "mark")
        .select("host", "line", "component")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )
    hosts = (
        docs.select("host", "mark")
        .distinct()
        .join(names, "mark", "left")
        .select("host", F.coalesce("component", "mark").alias("component"))
        .distinct()
        .groupBy("host")
        .agg(F.count("*").alias("host_documents"))
    )
    found = (
        counted.alias("l")
        .join(hosts.alias("h"), F.expr("l.host <=> h.host"))
        .filter(F.col("documents") >= F.col("host_documents") * (host_permille / 1000))
        .select("l.host", "l.line")
    )
    return found, held


def line_quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    host_permille: int = HOST_PERMILLE,
    min_left_percent: int = MIN_LEFT_PERCENT,
    min_left_words: int = MIN_WORDS,
    min_lost_percent: int = MIN_LOST_PERCENT,
) -> DataFrame:
    """Counts, removed boilerplate and verdict of every document.

    Returns id, host, the five counts, n_boilerplate_lines and
    n_boilerplate_words (what removal takes), gone (the numbers of those lines in
    the text, or null), base_failed and kept. A document
    is depleted, and not kept, when removal takes at least ``min_lost_percent`` of
    its words and leaves fewer than ``min_left_words`` or than ``min_left_percent``.
    """
    all_docs = measured(docs, id_column, text, host)
    found, held = boilerplate(all_docs, min_documents, host_permille)
    removed = (
        held.alias("a")
        .join(found.alias("b"), F.expr("a.line = b.line and a.host <=> b.host"))
        .groupBy(F.col(f"a.{ROW}"))
        .agg(
            F.count("*").alias("n_boilerplate_lines"),
            F.sum("a.words").alias("n_boilerplate_words"),
            F.array_sort(F.flatten(F.collect_list("a.numbers"))).alias("gone"),
        )
    )
    lost = F.coalesce("n_boilerplate_words", F.lit(0))
    left = F.col("n_words") - lost
    depleted = (lost > 0) & (lost * 100 >= F.col("n_words") * min_lost_percent) & (
        (left < min_left_words) | (left * 100 < F.col("n_words") * min_left_percent)
    )
    return (
        all_docs.drop("lines", "mark")
        .join(removed, ROW, "left")
        .withColumns(
            {
                "n_boilerplate_lines": F.coalesce("n_boilerplate_lines", F.lit(0)),
                "n_boilerplate_words": lost,
                "base_failed": base_failed(),
                "kept": ~base_failed() & ~depleted,
            }
        )
        .drop(ROW)
    )


def good_documents(docs: DataFrame, **options: str) -> DataFrame:
    """The documents that :func:`line_quality` keeps, without their hosts' boilerplate lines.

    ``_gone`` holds the numbers of the lines taken out, or null. Rows agreeing in
    id, host and text get one verdict; the key carries a text hash.
    """
    id_column = options.get("id_column", "doc_id")
    text = options.get("text", "text")
    host = options.get("host", "source")
    key = F.xxhash64(F.col(id_column), F.col(host), F.col(text), F.octet_length(text))
    marked = docs.select(key.alias("_key"), F.col(text).alias("text"), F.col(host).alias("source"))
    verdicts = (
        line_quality(marked, "_key", "text", "source")
        .filter(~F.col("kept") | F.col("gone").isNotNull())
        .groupBy(F.col("id").alias("_verdict"))
        .agg(F.bool_and("kept").alias("_kept"), F.min("gone").alias("_gone"))
    )
    plain = docs.drop("_verdict", "_kept", "_gone")
    return (
        plain.join(verdicts, key == F.col("_verdict"), "left")
        .filter(F.coalesce("_kept", F.lit(True)))
        .withColumn(text, without_lines(F.col(text), F.col("_gone")))
        .drop("_verdict", "_kept")
    )


def keep_good(docs: DataFrame, **options: str) -> DataFrame:
    """:func:`good_documents` with the columns of ``docs``."""
    return good_documents(docs, **options).select(docs.columns)
