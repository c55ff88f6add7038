"""Vector top-k, nearest-to-id and radius counts over request tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.operators import blockwise
from vitrine.session import row_count_up_to

# Pairs scored exactly in one go.
PAIRS_AT_ONCE = 1 << 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column at length 1; NaN where there is no direction."""
    vectors = matrix(column)
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def slack(size: int) -> float:
    """Most that the product of two unit vectors can be off in single precision."""
    return (size + 8) * 2.0**-24


def equal_codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of all pairs of the same code; negative codes have none."""
    order = np.argsort(left, kind="stable")
    ordered = left[order]
    rows = np.flatnonzero(right >= 0)
    first = np.searchsorted(ordered, right[rows], "left")
    times = np.searchsorted(ordered, right[rows], "right") - first
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return order[np.repeat(first, times) + place], np.repeat(rows, times)


def _codes(values: Any, known: pa.Array) -> np.ndarray:
    """Index of each value in ``known``; -1 for a value not in it."""
    found = pc.index_in(values, value_set=known)
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.fill_null(-1).to_numpy(zero_copy_only=False)


@dataclass
class CosineScorer:
    """Cosine distance with optional per-request conditions.

    Request columns beyond ``vector`` switch conditions on: ``category`` (equal),
    ``lo``/``hi`` (window on ``upserted_at``), ``exclude_id`` and
    ``after_dist``/``after_id`` (keyset paging). A NULL leaves that request
    without the condition.
    """

    conditions: frozenset[str] = frozenset()
    ascending: bool = True
    doc_columns: list[str] = field(init=False)
    request_columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.doc_columns = ["vector"]
        self.request_columns = ["vector"]
        if "category" in self.conditions:
            self.doc_columns.append("category")
            self.request_columns.append("category")
        if "window" in self.conditions:
            self.doc_columns.append("upserted_at")
            self.request_columns += ["lo", "hi"]
        if "exclude" in self.conditions:
            self.request_columns.append("exclude_id")
        if "after" in self.conditions:
            self.request_columns += ["after_dist", "after_id"]

    def pack(self, requests: pa.Table) -> dict[str, Any]:
        packed: dict[str, Any] = {"unit": unit_rows(requests.column("vector"))}
        if "category" in self.conditions:
            wanted = requests.column("category")
            packed["categories"] = pc.unique(wanted).drop_null()
            packed["category"] = _codes(wanted, packed["categories"])
            packed["any_category"] = wanted.is_null().to_numpy()
        if "window" in self.conditions:
            packed["lo"] = requests.column("lo").fill_null(np.iinfo(np.int64).min).to_numpy()
            packed["hi"] = requests.column("hi").fill_null(np.iinfo(np.int64).max).to_numpy()
        if "exclude" in self.conditions:
            excluded = requests.column("exclude_id")
            packed["excluded_ids"] = pc.unique(excluded).drop_null()
            packed["exclude"] = _codes(excluded, packed["excluded_ids"])
        if "after" in self.conditions:
            packed["after_dist"] = requests.column("after_dist").fill_null(-np.inf).to_numpy()
            packed["after_id"] = np.asarray(
                requests.column("after_id").fill_null("").to_pylist(), dtype=object
            )
        return packed

    def score(self, packed: dict[str, Any], docs: pa.Table) -> np.ndarray:
        dist = 1.0 - unit_rows(docs.column("vector")) @ packed["unit"].T
        if "category" in self.conditions:
            held = _codes(docs.column("category"), packed["categories"])
            same = held[:, None] == packed["category"][None, :]
            dist[~(same | packed["any_category"][None, :])] = np.nan
        if "window" in self.conditions:
            at = docs.column("upserted_at").to_numpy()[:, None]
            dist[~((at > packed["lo"][None, :]) & (at <= packed["hi"][None, :]))] = np.nan
        if "exclude" in self.conditions:
            held = _codes(docs.column("id"), packed["excluded_ids"])
            rows = np.nonzero(held >= 0)[0]
            if len(rows):
                hit, request = np.nonzero(held[rows][:, None] == packed["exclude"][None, :])
                dist[rows[hit], request] = np.nan
        if "after" in self.conditions:
            dist = np.round(dist, settings.DIST_PLACES)
            start = packed["after_dist"][None, :]
            dist[dist < start] = np.nan
            row, request = np.nonzero(dist == start)
            if len(row):
                ids = np.asarray(docs.column("id").to_pylist(), dtype=object)
                seen = ids[row] <= packed["after_id"][request]
                dist[row[seen], request[seen]] = np.nan
        return dist

    def cut(self, packed: dict[str, Any], low: int, high: int) -> dict[str, Any]:
        whole = ("categories", "excluded_ids")
        own = {name: v if name in whole else v[low:high] for name, v in packed.items()}
        own["near"] = own["unit"].astype(np.float32)
        return own

    def load(self, packed: dict[str, Any], docs: pa.Table) -> dict[str, Any]:
        unit = unit_rows(docs.column("vector"))
        loaded: dict[str, Any] = {"unit": unit, "near": unit.astype(np.float32), "slack": slack(unit.shape[1])}
        if "category" in self.conditions:
            loaded["category"] = _codes(docs.column("category"), packed["categories"])
        if "window" in self.conditions:
            loaded["at"] = docs.column("upserted_at").to_numpy()
        if "exclude" in self.conditions:
            loaded["excluded"] = _codes(docs.column("id"), packed["excluded_ids"])
        if "after" in self.conditions:
            loaded["id"] = docs.column("id").combine_chunks()
        return loaded

    def rough(self, packed: dict[str, Any], loaded: dict[str, Any], low: int, high: int) -> np.ndarray:
        near = packed["near"] @ loaded["near"][low:high].T
        if "category" in self.conditions:
            same = packed["category"][:, None] == loaded["category"][None, low:high]
            near[~(same | packed["any_category"][:, None])] = np.nan
        if "window" in self.conditions:
            at = loaded["at"][None, low:high]
            near[~((at > packed["lo"][:, None]) & (at <= packed["hi"][:, None]))] = np.nan
        if "exclude" in self.conditions:
            near[equal_codes(packed["exclude"], loaded["excluded"][low:high])] = np.nan
        return near

    def floors(self, loaded: dict[str, Any], bounds: np.ndarray) -> np.ndarray:
        return 1.0 - bounds - loaded["slack"]

    def least(self, loaded: dict[str, Any], rough: np.ndarray) -> np.ndarray:
        # Both values may be off, and costs are compared after rounding.
        return rough.astype(np.float64) - 2 * loaded["slack"] - 2 * blockwise.HALF_PLACE

    def ceilings(self, packed: dict[str, Any], loaded: dict[str, Any]) -> np.ndarray | None:
        if "after" not in self.conditions:
            return None
        return blockwise.below(self.floors(loaded, packed["after_dist"] + blockwise.HALF_PLACE))

    def costs(
        self, packed: dict[str, Any], loaded: dict[str, Any], request: np.ndarray, doc: np.ndarray, rough: np.ndarray
    ) -> np.ndarray:
        out = np.empty(len(request))
        for a in range(0, len(request), PAIRS_AT_ONCE):
            own = slice(a, a + PAIRS_AT_ONCE)
            out[own] = 1.0 - np.einsum("ij,ij->i", packed["unit"][request[own]], loaded["unit"][doc[own]])
        if "after" in self.conditions:
            dist, start = np.round(out, settings.DIST_PLACES), packed["after_dist"][request]
            seen = dist < start
            tied = np.flatnonzero(dist == start)
            ids = np.asarray(loaded["id"].take(pa.array(doc[tied])).to_pylist(), dtype=object)
            seen[tied] = ids <= packed["after_id"][request[tied]]
            out[seen] = np.nan
        return out


CONDITION_COLUMNS = {
    "category": ["category"],
    "window": ["lo", "hi"],
    "exclude": ["exclude_id"],
    "after": ["after_dist", "after_id"],
}


def scorer_for(requests: DataFrame) -> CosineScorer:
    """Scorer with the conditions that the request table has columns for."""
    return CosineScorer(
        frozenset(
            name
            for name, columns in CONDITION_COLUMNS.items()
            if set(columns) <= set(requests.columns)
        )
    )


def check_top_k(k: int) -> None:
    if not 1 <= k <= settings.MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {settings.MAX_TOP_K}")


def check_radius(radius: float) -> None:
    if not 0.0 <= radius <= settings.MAX_RADIUS:
        raise ValueError(f"max_distance must be between 0 and {settings.MAX_RADIUS}")


def vector_top_k(
    docs: DataFrame, requests: DataFrame, k: int = settings.SEARCH_TOP_K, **limits: int
) -> DataFrame:
    """``(request_id, id, dist, rank)`` by cosine distance, ties by id.

    Filter ``docs`` beforehand for conditions shared by all requests; those
    reach the scan. Conditions that differ per request go into the request table.
    """
    check_top_k(k)
    found = blockwise.score_top_k(
        docs.filter(F.col("vector").isNotNull()), requests, scorer_for(requests), k, **limits
    )
    return found.withColumnRenamed("score", "dist")


def radius_count(
    docs: DataFrame,
    requests: DataFrame,
    max_distance: float = settings.DEFAULT_RADIUS,
    **limits: int,
) -> DataFrame:
    """``(request_id, count, bounded, approximate, max_distance)``; exact counts."""
    check_radius(max_distance)
    counted = blockwise.score_count(
        docs.filter(F.col("vector").isNotNull()),
        requests,
        scorer_for(requests),
        max_distance,
        **limits,
    )
    return (
        requests.select("request_id")
        .join(counted, "request_id", "left")
        .select(
            "request_id",
            F.coalesce("within", F.lit(0)).alias("count"),
            F.lit(False).alias("bounded"),
            F.lit(False).alias("approximate"),
            F.lit(float(max_distance)).alias("max_distance"),
        )
    )


def search_with_count(
    docs: DataFrame,
    requests: DataFrame,
    k: int = settings.SEARCH_TOP_K,
    max_distance: float = settings.DEFAULT_RADIUS,
    **limits: int,
) -> DataFrame:
    """Hits and radius count of each request from a single pass over ``docs``.

    Rank 0 is the count row of a request: ``id`` is NULL and ``match_count`` set.
    """
    check_top_k(k)
    check_radius(max_distance)
    found = blockwise.score_top_k_with_count(
        docs.filter(F.col("vector").isNotNull()),
        requests,
        scorer_for(requests),
        k,
        max_distance,
        **limits,
    )
    # A request keeps its count row also where no document was scored for it.
    none = requests.select(
        "request_id", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("within"),
    )
    return (
        found.select("request_id", "rank", "id", "score", "within")
        .unionByName(none)
        .groupBy("request_id", "rank", "id")
        .agg(F.max("score").alias("dist"), F.max("within").alias("match_count"))
    )


def resolve_seeds(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stored vector of each seed row; ``missing`` marks an unknown seed.

    ``seeds`` holds ``request_id`` and ``seed_id`` plus any condition columns.
    """
    stored = docs.select(F.col("id").alias("seed_id"), "vector")
    wanted = seeds.select("seed_id").distinct()
    if row_count_up_to(wanted, settings.BROADCAST_LOOKUP_ROWS) <= settings.BROADCAST_LOOKUP_ROWS:
        # The outer join cannot broadcast the seeds, so the vectors are narrowed to them first.
        stored = stored.join(F.broadcast(wanted), "seed_id", "left_semi")
    return seeds.join(stored, "seed_id", "left").withColumn(
        "missing", F.col("vector").isNull()
    )


def nearest_to_id(
    docs: DataFrame, seeds: DataFrame, k: int = settings.SEARCH_TOP_K, **limits: int
) -> DataFrame:
    """Neighbours of stored items, the item itself left out."""
    resolved = resolve_seeds(docs, seeds).filter(~F.col("missing"))
    requests = resolved.withColumn("exclude_id", F.col("seed_id")).drop("missing")
    return vector_top_k(docs, requests, k, **limits)


def next_cursor(hits: DataFrame, k: int) -> DataFrame:
    """Keyset ``(after_dist, after_id)`` per request, only after a full page."""
    return (
        hits.filter(F.col("rank") == k)
        .select("request_id", F.col("dist").alias("after_dist"), F.col("id").alias("after_id"))
    )
