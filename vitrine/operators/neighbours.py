"""Neighbours of every stored vector through clustered cells.

Vectors are grouped into cells around centroids. A request first looks into its
own cell, which bounds how far its k-th neighbour can be, and then joins with
each other cell that the triangle inequality on the unit sphere cannot rule
out. The default answer is exact; ``probes`` limits the cells per request when an
approximate answer is wanted.

In the own cell requests and documents meet by equality on (cell, document block,
request block). Blocks have bounded size, so a cell that holds a large share of
the vectors is spread over many tasks. For the other cells, neighbouring cells
form bands of bounded size, and a request goes once to each band that holds a
cell it has to visit; the cells are picked there. Without clusters every cell has
to be visited: the work is then that of all pairs, but a vector is still copied
only once for each band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.operators.blockwise import HALF_PLACE, BestPool, bands, below, true_cells
from vitrine.operators.topk import top_k_per_key
from vitrine.operators.vector_search import PAIRS_AT_ONCE, equal_codes, matrix, slack, unit_rows
from vitrine.session import settle

MAX_CELLS = 4096
# Slack on angle bounds, above the error of arccos near 0.
ANGLE_SLACK = 2e-4


def fit_centroids(docs: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centroids, about the square root of the row count unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = docs.count()
    cells = cells or int(min(MAX_CELLS, max(1, math.isqrt(total))))
    if cells == 1 or total <= 1:
        size = docs.select(F.size("vector").alias("n")).first()
        return np.eye(1, size["n"] if size else 1)
    unit = docs.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    fit = KMeans(k=cells, seed=seed, maxIter=5, initMode="random", distanceMeasure="cosine")
    model = fit.fit(unit)
    centres = np.asarray(model.clusterCenters(), dtype=np.float64)
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def slices(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches small enough for a matrix with that many columns."""
    step = max(1, settings.MATRIX_CELLS // columns)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def assign_cells(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, vector, cell, angle)``: nearest centroid and the angle to it."""
    shared = docs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(centroids)):
            cosine = unit_rows(batch.column("vector")) @ shared.value.T
            cell = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(cell), pa.array(angle)],
                names=["id", "vector", "cell", "angle"],
            )

    return docs.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        run, "id string, vector array<double>, cell long, angle double"
    )


def _block_top_k(k: int):
    """Best ``k`` documents of a block for each request of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("request_id", pa.string()), ("id", pa.string()), ("dist", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        wanted = matrix(right.column("r_vector"))
        wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
        names = right.column("request_id").to_pylist()
        place = {name: row for row, name in enumerate(names)}
        pool = BestPool(len(names), k)
        step = max(1, settings.MATRIX_CELLS // len(names))
        for start in range(0, left.num_rows, step):
            docs = left.slice(start, step)
            vectors = matrix(docs.column("vector"))
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            dist = np.round(1.0 - vectors @ wanted.T, settings.DIST_PLACES) + 0.0
            ids = docs.column("id").combine_chunks()
            for row, name in enumerate(ids.to_pylist()):
                if name in place:
                    dist[row, place[name]] = np.nan
            pool.add(dist, ids)
        best = pool.compact()
        return pa.table(
            [pa.array(names, pa.string()).take(best.column("r")), best.column("id"), best.column("cost")],
            schema=out,
        )

    return run


def _meet(placed: DataFrame, probes: DataFrame, k: int, block_docs: int, block_requests: int) -> DataFrame:
    """Partial rankings of ``probes`` (request_id, vector, cell) against their cells."""
    doc_blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_docs).alias("doc_blocks"))
    request_blocks = probes.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block_requests).alias("request_blocks")
    )
    # One row per cell, and cells are bounded by MAX_CELLS.
    blocks = F.broadcast(doc_blocks.join(request_blocks, "cell"))
    left = (
        placed.join(blocks, "cell")
        .select(
            "cell",
            "id",
            "vector",
            F.pmod(F.xxhash64("id"), F.col("doc_blocks")).alias("db"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("request_blocks") - 1)).alias("rb"),
        )
    )
    right = (
        probes.join(blocks, "cell")
        .select(
            F.col("cell").alias("r_cell"),
            "request_id",
            F.col("vector").alias("r_vector"),
            F.pmod(F.xxhash64("request_id"), F.col("request_blocks")).alias("r_rb"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_blocks") - 1)).alias("r_db"),
        )
    )
    wanted = right.groupBy("r_cell", "r_db", "r_rb")
    return left.groupBy("cell", "db", "rb").cogroup(wanted).applyInArrow(
        _block_top_k(k), "request_id string, id string, dist double"
    )


class Visits:
    """Which cells a request still has to visit, its own left out.

    ``bound`` is the distance that a better neighbour cannot exceed. A cell is
    visited when the angle to its centroid less its radius is within that of the
    bound, or with ``probes`` when it is among that many nearest ones.
    """

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, probes: int | None) -> None:
        self.centroids, self.radii, self.probes = centroids, radii, probes

    def of(self, unit: np.ndarray, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(unit @ self.centroids.T, -1.0, 1.0))
        if self.probes is None:
            # Distances are rounded, so a bound is widened by half a last place.
            reach = np.arccos(np.clip(1.0 - bound - 2 * HALF_PLACE, -1.0, 1.0))
            visit = angle - self.radii[None, :] <= reach[:, None] + ANGLE_SLACK
        else:
            nearest = np.argsort(angle, axis=1)[:, : self.probes]
            visit = np.zeros(angle.shape, dtype=bool)
            np.put_along_axis(visit, nearest, True, axis=1)
        visit &= self.radii[None, :] >= 0
        visit[np.arange(len(own)), own] = False
        return visit


def deal(counts: np.ndarray, order: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First band and number of bands of every cell: bands of at most ``rows`` rows, cells in ``order``."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    band = held = 0
    for cell in order.tolist():
        n = int(counts[cell])
        if held and held + n > rows:
            band, held = band + 1, 0
        first[cell], parts[cell] = band, max(1, math.ceil(n / rows))
        held += n
        if parts[cell] > 1:
            band, held = band + parts[cell], 0
    return first, parts


def _bands_to_visit(requests: DataFrame, visits: Visits, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``requests`` (request_id, vector, cell, bound, rb) once for each band of cells ``db`` to visit."""
    shared = requests.sparkSession.sparkContext.broadcast((visits, first, parts))
    schema = requests.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, first, parts = shared.value
        member = np.zeros((len(first), int((first + parts).max())), np.float32)
        for cell, (a, n) in enumerate(zip(first, parts)):
            member[cell, a : a + n] = 1
        for batch in slices(batches, len(first)):
            visit = wanted.of(
                unit_rows(batch.column("vector")),
                batch.column("cell").to_numpy(zero_copy_only=False),
                batch.column("bound").to_numpy(zero_copy_only=False),
            )
            needed = visit.astype(np.float32) @ member > 0
            # One band at a time, so that no batch is larger than what came in.
            for band in np.flatnonzero(needed.any(axis=0)):
                rows = batch.take(pa.array(np.flatnonzero(needed[:, band])))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(rows.num_rows, band, np.int64))], names=[*schema.names, "db"]
                )

    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return requests.mapInArrow(run, f"{held}, db long")


def _band_top_k(visits: Visits, k: int):
    """Best ``k`` documents of a band for each request, in the cells it visits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("request_id", pa.string()), ("id", pa.string()), ("dist", pa.float64())])
        found = [out.empty_table()]
        if not left.num_rows or not right.num_rows:
            return found[0]
        left = left.take(pc.sort_indices(left.column("cell"))).combine_chunks()
        right = right.take(pc.sort_indices(right.column("r_cell"))).combine_chunks()
        ids, names = left.column("id").combine_chunks(), right.column("request_id").combine_chunks()
        docs = unit_rows(left.column("vector"))
        near = docs.astype(np.float32)
        cells, start = np.unique(left.column("cell").to_numpy(), return_index=True)
        spans = list(zip(cells.tolist(), start.tolist(), [*start[1:].tolist(), len(docs)]))
        off = slack(docs.shape[1])
        # Rows of the same id are no neighbours of each other.
        known = pc.unique(ids)
        held = pc.index_in(ids, value_set=known).to_numpy()
        for low in range(0, len(names), settings.TILE_REQUESTS):
            tile = right.slice(low, settings.TILE_REQUESTS)
            unit = unit_rows(tile.column("r_vector"))
            bound = tile.column("bound").to_numpy()
            visit = visits.of(unit, tile.column("r_cell").to_numpy(), bound)
            own = names.slice(low, settings.TILE_REQUESTS)
            code = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy()
            request, doc = equal_codes(code, held)
            same = np.sort(request * len(docs) + doc)
            pool = BestPool(len(unit), k)
            pool.bound = bound.copy()
            rough = unit.astype(np.float32)
            for cell, begin, end in spans:
                rows = np.flatnonzero(visit[:, cell])
                if not len(rows):
                    continue
                step = max(1, settings.TILE_CELLS // len(rows))
                for a in range(begin, end, step):
                    b = min(a + step, end)
                    floor = 1.0 - pool.bound[rows] - HALF_PLACE - off
                    request, doc = true_cells(rough[rows] @ near[a:b].T >= below(floor)[:, None])
                    request, doc = rows[request], doc + a
                    other = ~np.isin(request * len(docs) + doc, same)
                    request, doc = request[other], doc[other]
                    for c in range(0, len(request), PAIRS_AT_ONCE):
                        r, d = request[c : c + PAIRS_AT_ONCE], doc[c : c + PAIRS_AT_ONCE]
                        dist = 1.0 - np.einsum("ij,ij->i", unit[r], docs[d])
                        pool.take(r, np.round(dist, settings.DIST_PLACES) + 0.0, ids, d)
            best = pool.compact()
            found.append(pa.table([own.take(best.column("r")), best.column("id"), best.column("cost")], schema=out))
        return pa.concat_tables(found)

    return run


def _meet_bands(
    placed: DataFrame, requests: DataFrame, visits: Visits, counts: np.ndarray, k: int, block_docs: int, block_requests: int
) -> DataFrame:
    """Partial rankings of ``requests`` (request_id, vector, cell, bound) against the cells they visit."""
    spark = placed.sparkSession
    # Neighbouring cells stand next to each other, so that a request of a cluster needs few bands.
    centred = visits.centroids - visits.centroids.mean(axis=0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    total = int(counts.sum())
    shares = (
        bands(total, block_docs, settings.BAND_DOCS, settings.LEAST_DOC_BANDS),
        bands(total, block_requests, settings.BAND_REQUESTS, settings.LEAST_REQUEST_BANDS),
    )
    first, parts = deal(counts, order, math.ceil(total / shares[0]))
    r_first, r_parts = deal(counts, order, math.ceil(total / shares[1]))
    layout = F.broadcast(
        spark.createDataFrame(
            [tuple(map(int, row)) for row in zip(range(len(counts)), first, parts, r_first, r_parts)],
            "cell long, d_first long, d_parts long, r_first long, r_parts long",
        )
    )
    rb = (F.col("r_first") + F.pmod(F.xxhash64("request_id"), F.col("r_parts"))).alias("rb")
    dealt = settle(requests.join(layout, "cell").select("request_id", "vector", "cell", "bound", rb))
    going = _bands_to_visit(dealt, visits, first, parts)
    # At most one row for each pair of bands.
    pairs = F.broadcast(settle(going.select("db", "rb").distinct()))
    db = (F.col("d_first") + F.pmod(F.xxhash64("id"), F.col("d_parts"))).alias("db")
    left = placed.join(layout, "cell").select("cell", "id", "vector", db).join(pairs, "db")
    right = going.select(
        F.col("db").alias("r_db"), F.col("rb").alias("r_rb"), "request_id", F.col("vector").alias("r_vector"),
        F.col("cell").alias("r_cell"), "bound",
    )
    return (
        left.groupBy("db", "rb")
        .cogroup(right.groupBy("r_db", "r_rb"))
        .applyInArrow(_band_top_k(visits, k), "request_id string, id string, dist double")
    )


def all_neighbours(
    docs: DataFrame,
    k: int = settings.SEARCH_TOP_K,
    cells: int | None = None,
    probes: int | None = None,
    block_docs: int = settings.BLOCK_DOCS,
    block_requests: int = settings.BLOCK_REQUESTS,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """``(request_id, id, dist, rank)``: the ``k`` nearest others of every document.

    With ``seeds`` (a table with ``id``) only for those documents. Centroids are
    fitted on all rows.
    """
    # A vector without a direction is no neighbour and has none, as in nearest_to_id.
    directed = F.exists("vector", lambda x: x != 0)
    stored = docs.filter(F.col("vector").isNotNull() & directed).select("id", "vector")
    centroids = fit_centroids(stored, cells)
    placed = settle(assign_cells(stored, centroids))
    order = [F.col("dist"), F.col("id")]

    asked = placed if seeds is None else placed.join(seeds.select("id"), "id", "left_semi")
    own = asked.select(F.col("id").alias("request_id"), "vector", "cell")
    near = settle(
        top_k_per_key(
            _meet(placed, own, k, block_docs, block_requests), ["request_id"], order, k
        )
    )
    full = near.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("last"))
    bound = full.select("request_id", F.when(F.col("n") >= k, F.col("last")).alias("bound"))
    radii, counts = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for row in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
    if not counts.any():
        return near
    requests = own.join(bound, "request_id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    rest = _meet_bands(placed, requests, Visits(centroids, radii, probes), counts, k, block_docs, block_requests)
    merged = near.select("request_id", "id", "dist").unionByName(rest)
    return top_k_per_key(merged, ["request_id"], order, k)
