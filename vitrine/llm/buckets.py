"""Links inside buckets of fingerprints, without writing out pairs.

Rows (key, mark) sorted by key stream through a task; a bucket is one run of
equal keys. In a bucket only a spanning forest of its links is kept: members
that are already connected are not compared again, and comparisons start from
the smaller components, so a dense group of near copies costs a few passes over
its members and yields one edge per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

BLOCK = 1 << 16


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of ``key`` of at least two rows each."""
    carried: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows.column(key).to_numpy()
        if carried and carried[-1].column(key)[-1].as_py() != keys[0]:
            yield from repeated(pa.concat_tables(carried), key)
            carried = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from repeated(pa.concat_tables([*carried, rows.slice(0, last)]), key)
            carried = []
        carried.append(rows.slice(last))
    if carried:
        yield from repeated(pa.concat_tables(carried), key)


def repeated(rows: pa.Table, key: str) -> Iterator[pa.Table]:
    keys = rows.column(key).to_numpy()
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    kept = same[:-1] | same[1:]
    if kept.any():
        yield rows.filter(pa.array(kept))


def run_bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links of ``n`` members.

    ``near(i, others)`` tells which of ``others`` link to ``i``. Exact: of any
    two members in different components, one lies outside the largest and is
    compared with every member that it is not connected to yet.
    """
    label = np.arange(n)
    edges: list[tuple[int, int]] = []
    done = np.zeros(n, bool)
    while True:
        sizes = np.bincount(label, minlength=n)
        largest = int(sizes.argmax())
        open_members = np.flatnonzero(~done & (label != largest))
        if not len(open_members):
            return edges
        for i in open_members.tolist():
            done[i] = True
            others = np.flatnonzero(label != label[i])
            if not len(others):
                return edges
            for j in others[near(i, others)].tolist():
                if label[j] != label[i]:
                    edges.append((i, j))
                    old, new = label[j], label[i]
                    label[label == old] = new
            # The first star usually becomes the largest component: look again.
            if len(edges) and sizes.max() == 1:
                break


def by_key(df: DataFrame, key: str | Column, *order: str) -> DataFrame:
    """Rows of a key together and sorted, in as many partitions as the session shuffles into."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = (key,) if isinstance(key, str) else ()
    return df.repartition(n, key).sortWithinPartitions(*first, *order)
