"""Bounded slices of Arrow text columns and whole-slice word hashing in numpy.

Python workers see a text column as slices of a few megabytes, as raw UTF-8
with row offsets, so memory follows the slice and the longest text, not the
batch. Words and their hashes come from array operations over the slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` text bytes: (rows, bytes, offsets). A null text is empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[
            texts.offset : texts.offset + len(texts) + 1
        ].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, ends[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            offsets = ends[low : high + 1]
            yield (
                batch.slice(low, high - low),
                data[offsets[0] : offsets[-1]],
                offsets - offsets[0],
            )
            low = high


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table of the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Words of a slice; ``first[i]:first[i + 1]`` are the words of row ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(member: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of true bytes that do not cross a row's end."""
    cut = np.zeros(len(member) + 1, bool)
    cut[offsets] = True
    begin = member.copy()
    begin[1:] &= ~member[:-1] | cut[1:-1]
    end = member.copy()
    end[:-1] &= ~member[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            up = np.full(n, BASE, np.uint64)
            down = np.full(n, INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of ``values + 1`` modulo 2^64."""
    up, _down = POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, equal for equal spans anywhere."""
    _up, down = POWERS.upto(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + BASE * (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range of positions."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list array that deals ``values`` out to rows of ``counts`` entries."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    items = values if isinstance(values, pa.Array) else pa.array(values, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
