"""Top-k documents for each row of a request table, scored block by block.

A scorer turns a tile of requests and a tile of documents into one matrix of
rough scores in single precision. Only pairs that can still be among the best
``k`` of their request are scored exactly, and a task keeps only the best ``k``
documents of each request it has seen, so no request/document pair is ever
written out; a window then merges the small per-task results.

A request table within ``broadcast_limit`` rows is gathered and broadcast and the
documents are read once in place. A larger one is dealt into bands of blocks,
documents likewise, and every pair of bands meets in one bounded task: a row is
copied once for each band of the other side, not for each block. Both ways give
the same complete answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import settings
from vitrine.operators.topk import top_k_per_key
from vitrine.session import settle

# Half of the last place that costs are rounded to.
HALF_PLACE = 0.5 * 10.0**-settings.DIST_PLACES


class Scorer(Protocol):
    """Scoring rule shared by both paths.

    ``doc_columns`` and ``request_columns`` are what the rule reads beside ``id``
    and ``request_id``. ``score`` returns a float64 matrix (documents by requests);
    NaN marks a document that is no answer to a request.

    The ranking works on costs, the score or its negative so that small ones are
    best. ``rough`` returns a float32 matrix (requests by documents) that falls
    with the cost, NaN where ``score`` has it; ``floors`` gives the rough values
    below which the cost is above a bound, ``least`` those below which it is above
    that of a pair with a given rough value; ``costs`` are exact, NaN for a pair that
    only they can tell to be no answer. Pairs below the ``ceilings`` of their requests
    are not of that kind; there are none where ``rough`` has every NaN.
    """

    doc_columns: list[str]
    request_columns: list[str]
    ascending: bool

    def pack(self, requests: pa.Table) -> Any: ...

    def score(self, packed: Any, docs: pa.Table) -> np.ndarray: ...

    def cut(self, packed: Any, low: int, high: int) -> Any: ...

    def load(self, packed: Any, docs: pa.Table) -> Any: ...

    def rough(self, packed: Any, loaded: Any, low: int, high: int) -> np.ndarray: ...

    def floors(self, loaded: Any, bounds: np.ndarray) -> np.ndarray: ...

    def least(self, loaded: Any, rough: np.ndarray) -> np.ndarray: ...

    def ceilings(self, packed: Any, loaded: Any) -> np.ndarray | None: ...

    def costs(
        self, packed: Any, loaded: Any, request: np.ndarray, doc: np.ndarray, rough: np.ndarray
    ) -> np.ndarray: ...


def true_cells(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the few true cells of a matrix, looked for eight at a time."""
    flat = held.reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        words = np.flatnonzero(flat.view(np.uint64))
        word, place = np.nonzero(flat.reshape(-1, 8)[words])
        at = words[word] * 8 + place
    return np.divmod(at, held.shape[1])


def below(values: np.ndarray) -> np.ndarray:
    """Single-precision numbers at or below the values."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


class BestPool:
    """Running best ``k`` per request within one task."""

    def __init__(self, requests: int, k: int) -> None:
        self.k = k
        self.requests = requests
        self.bound = np.full(requests, np.inf)
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, cost: np.ndarray, ids: pa.Array) -> None:
        """All costs of some documents (documents by requests)."""
        keep = cost <= self.bound
        if len(ids) > self.k and np.count_nonzero(keep) > 4 * self.requests * self.k:
            kth = np.partition(cost, self.k - 1, axis=0)[self.k - 1]
            limit = np.fmin(self.bound, np.where(np.isnan(kth), np.inf, kth))
            keep = cost <= limit
        doc, request = np.nonzero(keep)
        self.take(request, cost[doc, request], ids, doc)

    def take(self, request: np.ndarray, cost: np.ndarray, ids: pa.Array, doc: np.ndarray) -> None:
        """Costs of single pairs; those above their bound are left out."""
        keep = np.flatnonzero(cost <= self.bound[request])
        if not len(keep):
            return
        self.parts.append(
            pa.table(
                {"r": pa.array(request[keep].astype(np.int64)), "cost": pa.array(cost[keep]), "id": ids.take(pa.array(doc[keep]))}
            )
        )
        self.held += len(keep)
        if self.held > 2 * self.requests * self.k + 10_000 or len(self.parts) == 1:
            self.compact()

    def compact(self) -> pa.Table:
        """The best so far as ``(r, cost, id)``, in that order."""
        if not self.parts:
            return pa.table({"r": pa.array([], pa.int64()), "cost": pa.array([], pa.float64()), "id": pa.array([], pa.string())})
        best = pa.concat_tables(self.parts).combine_chunks()
        best = best.take(pc.sort_indices(best, [(c, "ascending") for c in ("r", "cost", "id")]))
        request = best.column("r").to_numpy()
        new = np.ones(len(request), bool)
        new[1:] = request[1:] != request[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(request)) - np.repeat(first, np.diff(np.append(first, len(request))))
        last = np.flatnonzero(place == self.k - 1)
        self.bound[request[last]] = best.column("cost").to_numpy()[last]
        best = best.take(pa.array(np.flatnonzero(place < self.k))).combine_chunks()
        self.parts = [best]
        self.held = best.num_rows
        return best


def offer(
    pool: BestPool, scorer: Scorer, packed: Any, loaded: Any, low: int, high: int, ids: pa.Array
) -> None:
    """Pass the documents ``low:high`` that can be among a request's best to the pool."""
    rough = scorer.rough(packed, loaded, low, high)
    floor = scorer.floors(loaded, pool.bound + HALF_PLACE)
    open_ = np.flatnonzero(np.isinf(pool.bound))
    if len(open_) and high - low > pool.k:
        own = rough if len(open_) == len(rough) else rough[open_]
        ceiling = scorer.ceilings(packed, loaded)
        sure = ~np.isnan(own) if ceiling is None else own < ceiling[open_, None]
        own = np.where(sure, own, -np.inf)
        kth = np.partition(own, high - low - pool.k, axis=1)[:, high - low - pool.k]
        floor[open_] = scorer.least(loaded, kth)
    request, doc = true_cells(rough >= below(floor)[:, None])
    if not len(request):
        return
    costs = scorer.costs(packed, loaded, request, doc + low, rough[request, doc])
    pool.take(request, np.round(costs, settings.DIST_PLACES) + 0.0, ids, doc + low)


def _as_table(block: pa.Table | pa.RecordBatch) -> pa.Table:
    if isinstance(block, pa.RecordBatch):
        return pa.Table.from_batches([block])
    return block.combine_chunks()


def _best_of(
    scorer: Scorer, requests: pa.Table, blocks: Iterator[pa.Table], k: int, tile: int
) -> Iterator[tuple[int, pa.Table]]:
    """``(first, best)`` of every tile of requests, numbered from ``first`` on."""
    packed = scorer.pack(requests)
    lows = range(0, requests.num_rows, tile)
    tiles = [scorer.cut(packed, low, low + tile) for low in lows]
    pools = [BestPool(min(tile, requests.num_rows - low), k) for low in lows]
    step = max(1, settings.TILE_CELLS // min(tile, requests.num_rows))
    for block in blocks:
        loaded = scorer.load(packed, block)
        ids = block.column("id").combine_chunks()
        for own, pool in zip(tiles, pools):
            for start in range(0, block.num_rows, step):
                offer(pool, scorer, own, loaded, start, min(start + step, block.num_rows), ids)
    for low, pool in zip(lows, pools):
        yield low, pool.compact()


def _scan(
    scorer: Scorer,
    requests: pa.Table,
    blocks: Iterator[pa.Table],
    k: int,
    radius: float | None,
    out: pa.Schema,
    tile: int,
) -> Iterator[pa.RecordBatch]:
    count = requests.num_rows
    if not count:
        return
    within = np.zeros(count, dtype=np.int64)
    if radius is None:
        found = _best_of(scorer, requests, blocks, k, min(tile, settings.TILE_REQUESTS))
    else:
        # Counts take every pair, so all are scored exactly.
        parts = []
        tile = min(tile, settings.BLOCK_REQUESTS)
        lows = range(0, count, tile)
        own = [scorer.pack(requests.slice(low, tile).combine_chunks()) for low in lows]
        pools = [BestPool(min(tile, count - low), k) for low in lows]
        step = max(1, settings.MATRIX_CELLS // min(tile, count))
        for block in blocks:
            for start in range(0, block.num_rows, step):
                docs = block.slice(start, step).combine_chunks()
                ids = docs.column("id").combine_chunks()
                for low, packed, pool in zip(lows, own, pools):
                    scores = np.round(scorer.score(packed, docs), settings.DIST_PLACES) + 0.0
                    within[low : low + tile] += np.count_nonzero(scores <= radius, axis=0)
                    pool.add(scores if scorer.ascending else -scores, ids)
        parts += [(low, pool.compact()) for low, pool in zip(lows, pools)]
        found = iter(parts)
    names = requests.column("request_id").combine_chunks()
    for low, best in found:
        if best.num_rows:
            costs = best.column("cost").to_numpy()
            yield from pa.table(
                [
                    names.take(pa.array(best.column("r").to_numpy() + low)),
                    best.column("id"),
                    pa.array((costs if scorer.ascending else -costs) + 0.0),
                    pa.nulls(best.num_rows, pa.int64()),
                ],
                schema=out,
            ).to_batches()
    if radius is not None:
        yield from pa.table(
            [names, pa.nulls(count, pa.string()), pa.nulls(count, pa.float64()), pa.array(within)],
            schema=out,
        ).to_batches()


def bands(rows: int, block: int, largest: int, least: int) -> int:
    """Bands that ``rows`` are dealt into: of whole blocks, at most ``largest`` rows unless a block
    is larger, and where there are blocks enough at least ``least`` so that tasks share the work."""
    blocks = max(1, math.ceil(rows / block))
    return max(math.ceil(rows / max(block, largest)), min(blocks, least), 1)


def _partials(
    docs: DataFrame,
    requests: DataFrame,
    scorer: Scorer,
    k: int,
    radius: float | None,
    broadcast_limit: int,
    block_docs: int,
    block_requests: int,
) -> DataFrame:
    """Per-task best rows ``(request_id, id, score, within)``."""
    docs = docs.select(F.col("id").cast("string").alias("id"), *scorer.doc_columns)
    requests = requests.select("request_id", *scorer.request_columns)
    request_type = requests.schema["request_id"].dataType
    schema = T.StructType(
        [
            T.StructField("request_id", request_type),
            T.StructField("id", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("within", T.LongType()),
        ]
    )
    # Requests may be the outcome of another search; they are worked out once.
    requests = settle(requests)
    gathered = requests.limit(broadcast_limit + 1).toArrow()
    out = pa.schema(
        [
            gathered.schema.field("request_id").with_nullable(True),
            pa.field("id", pa.string()),
            pa.field("score", pa.float64()),
            pa.field("within", pa.int64()),
        ]
    )
    if gathered.num_rows <= broadcast_limit:
        shared = docs.sparkSession.sparkContext.broadcast(gathered)

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan(
                scorer, shared.value, (_as_table(b) for b in batches), k, radius, out, block_requests
            )

        return docs.mapInArrow(in_place, schema)

    doc_bands = bands(docs.count(), block_docs, settings.BAND_DOCS, settings.LEAST_DOC_BANDS)
    request_bands = bands(
        requests.count(), block_requests, settings.BAND_REQUESTS, settings.LEAST_REQUEST_BANDS
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("r_") for c in right.column_names])
        parts = list(
            _scan(
                scorer, right.combine_chunks(), iter([_as_table(left)]), k, radius, out, block_requests
            )
        )
        return pa.Table.from_batches(parts, schema=out)

    spread_docs = docs.withColumn(
        "_db", F.pmod(F.xxhash64("id"), F.lit(doc_bands))
    ).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(request_bands - 1))))
    # Renamed columns keep the two sides apart when both come from one table.
    spread_requests = requests.select(
        *[F.col(c).alias(f"r_{c}") for c in requests.columns],
        F.pmod(F.xxhash64("request_id"), F.lit(request_bands)).cast("int").alias("r_rb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(doc_bands - 1).cast("long"))).alias("r_db"),
    )
    return (
        spread_docs.groupBy("_db", "_rb")
        .cogroup(spread_requests.groupBy("r_db", "r_rb"))
        .applyInArrow(meet, schema)
    )


def score_top_k(
    docs: DataFrame,
    requests: DataFrame,
    scorer: Scorer,
    k: int,
    *,
    broadcast_limit: int = settings.BROADCAST_REQUESTS,
    block_docs: int = settings.BLOCK_DOCS,
    block_requests: int = settings.BLOCK_REQUESTS,
) -> DataFrame:
    """``(request_id, id, score, rank)``, best first, ties by id, rank from 1."""
    partials = _partials(
        docs, requests, scorer, k, None, broadcast_limit, block_docs, block_requests
    ).drop("within")
    score = F.col("score")
    return top_k_per_key(
        partials,
        ["request_id"],
        [score.asc() if scorer.ascending else score.desc(), F.col("id")],
        k,
    )


def score_top_k_with_count(
    docs: DataFrame,
    requests: DataFrame,
    scorer: Scorer,
    k: int,
    radius: float,
    *,
    broadcast_limit: int = settings.BROADCAST_REQUESTS,
    block_docs: int = settings.BLOCK_DOCS,
    block_requests: int = settings.BLOCK_REQUESTS,
) -> DataFrame:
    """Top-k and the number of documents within ``radius`` from one scan.

    Every request keeps one row with a NULL ``id`` and rank 0 that carries
    ``within``; its hits follow with rank 1 and up.
    """
    partials = _partials(
        docs, requests, scorer, k, radius, broadcast_limit, block_docs, block_requests
    )
    # Fold the counts into the few per-task rows so one exchange serves both.
    score = F.col("score")
    is_hit = F.col("id").isNotNull()
    ranked = top_k_per_key(
        partials.groupBy("request_id", "id", "score").agg(F.sum("within").alias("within")),
        ["request_id"],
        [is_hit.asc(), score.asc() if scorer.ascending else score.desc(), F.col("id")],
        k + 1,
    )
    return ranked.withColumn("rank", F.col("rank") - 1)


def score_count(
    docs: DataFrame,
    requests: DataFrame,
    scorer: Scorer,
    radius: float,
    *,
    broadcast_limit: int = settings.BROADCAST_REQUESTS,
    block_docs: int = settings.BLOCK_DOCS,
    block_requests: int = settings.BLOCK_REQUESTS,
) -> DataFrame:
    """``(request_id, within)``: documents scoring at most ``radius``."""
    partials = _partials(
        docs, requests, scorer, 1, radius, broadcast_limit, block_docs, block_requests
    )
    return partials.groupBy("request_id").agg(F.coalesce(F.sum("within"), F.lit(0)).alias("within"))
