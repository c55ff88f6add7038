"""Approximate neighbours of every stored vector through hashed hyperplanes.

Each of several tables cuts the sphere by random hyperplanes; the sides a
vector lies on are its bucket. A request looks into its own bucket of every
table and then into the buckets behind the planes it lies closest to, where it
only takes what beats the k-th distance it already has. Requests and documents
meet by equality on the bucket. The number of planes follows the row count, so
the work of one request stays the same when the table grows.

Equal vectors are searched once: a class of equals stands behind its smallest
id, and its first ``k + 1`` ids are put back at the end. Buckets of many
different vectors are spread over blocks of bounded size.

Null vectors, and vectors without a direction, are no neighbours and have none;
equal distances rank by id; an empty table has no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.operators.topk import top_k_per_key
from vitrine.operators.vector_search import matrix
from vitrine.session import settle

TABLES = 8
PROBES = 6
# Distinct vectors aimed at in one bucket.
BUCKET = 64
# Planes closest to a request of which up to three are crossed.
CROSSABLE = 10
# Buckets scored in one call, as powers of two, and rows of one bucket in a block:
# a call holds at most 2 ** PACK_BITS blocks of either side.
PACK_BITS = 4
BLOCK_ROWS = 2048
HIT = np.dtype([("request", np.int64), ("doc", np.int64), ("dist", np.float64)])
FOUND = "request_id string, id string, dist double"


def hyperplanes(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Normals of all tables, one column each."""
    return np.random.default_rng(seed).normal(size=(size, tables * bits))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    vectors = matrix(column)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def crossings(bits: int) -> np.ndarray:
    """Sets of the closest planes that a probe may cross, as rows of 0 and 1."""
    near = min(bits, CROSSABLE)
    sets = [s for size in range(4) for s in combinations(range(near), size)]
    rows = np.zeros((len(sets), near))
    for row, chosen in enumerate(sets):
        rows[row, list(chosen)] = 1
    return rows


def probe_codes(margins: np.ndarray, probes: int) -> np.ndarray:
    """Bucket codes of one table per vector: its own first, then the likeliest others.

    A bucket's cost is the sum of the squared distances to the planes crossed.
    With fewer than ``probes`` crossings possible there are fewer columns.
    """
    weights = 1 << np.arange(margins.shape[1], dtype=np.int64)
    own = (margins > 0) @ weights
    sets = crossings(margins.shape[1])
    if probes == 1 or len(sets) == 1:
        return own[:, None]
    closest = np.argsort(np.abs(margins), axis=1, kind="stable")[:, : sets.shape[1]]
    cost = np.take_along_axis(margins, closest, axis=1) ** 2 @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, : min(probes, len(sets))]
    # Weights are distinct powers of two, so a sum is their union.
    flips = weights[closest] @ sets.T.astype(np.int64)
    return own[:, None] ^ np.take_along_axis(flips, best, axis=1)


def _place(rows: DataFrame, planes: np.ndarray, tables: int, probes: int, skip: int) -> DataFrame:
    """``rows`` once per visited bucket, as ``cell``; the first ``skip`` probes are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(planes)
    bits = planes.shape[1] // tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            margins = _unit(batch.column("vector")) @ shared.value
            for table in range(tables):
                codes = probe_codes(margins[:, table * bits : (table + 1) * bits], probes)[:, skip:]
                if not codes.shape[1]:
                    continue
                row = np.repeat(np.arange(batch.num_rows), codes.shape[1])
                again = batch.take(pa.array(row))
                cell = pa.array(codes.ravel() + (table << bits))
                yield pa.RecordBatch.from_arrays(
                    [*again.columns, cell], names=[*batch.schema.names, "cell"]
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, cell long")


def _cut(best: np.ndarray, requests: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``k`` of each request by distance, then document; and the k-th distances."""
    best = best[np.lexsort((best["doc"], best["dist"], best["request"]))]
    starts = np.searchsorted(best["request"], np.arange(requests))
    place = np.arange(len(best)) - starts[best["request"]]
    bound = np.full(requests, np.inf)
    last = place == k - 1
    bound[best["request"][last]] = best["dist"][last]
    return best[place < k], bound


def _nearest_of_bucket(
    docs: np.ndarray, requests: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int
) -> np.ndarray:
    """Best ``k`` documents for each request, none behind its ``reach``.

    Both sides are unit vectors, documents in the order of their ids, so that a
    document's place breaks ties. ``own`` is where a request stands itself.
    """
    best, bound = np.empty(0, HIT), reach
    step = max(1, settings.MATRIX_CELLS // len(requests))
    for start in range(0, len(docs), step):
        dist = np.round(1.0 - docs[start : start + step] @ requests.T, settings.DIST_PLACES) + 0.0
        mine = np.flatnonzero((own >= start) & (own < start + len(dist)))
        dist[own[mine] - start, mine] = np.inf
        limit = bound
        if len(dist) > k:
            limit = np.minimum(bound, np.partition(dist, k - 1, axis=0)[k - 1])
        doc, request = np.nonzero((dist <= limit) & np.isfinite(dist))
        met = np.empty(len(doc), HIT)
        met["request"], met["doc"], met["dist"] = request, doc + start, dist[doc, request]
        best, kth = _cut(np.concatenate([best, met]), len(requests), k)
        bound = np.minimum(reach, kth)
    return best


def _nearest_of_pack(k: int):
    """Rankings of the requests of a pack of buckets, each within its bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("request_id", pa.string()), ("id", pa.string()), ("dist", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left = left.sort_by([("cell", "ascending"), ("id", "ascending")])
        right = right.sort_by("cell")
        docs, requests = _unit(left.column("vector")), _unit(right.column("vector"))
        ids, names = left.column("id"), right.column("request_id")
        left_cell, right_cell = left.column("cell").to_numpy(), right.column("cell").to_numpy()
        reach = right.column("reach").to_numpy()
        hits = []
        for cell in np.intersect1d(left_cell, right_cell):
            a, b = np.searchsorted(left_cell, [cell, cell + 1])
            c, d = np.searchsorted(right_cell, [cell, cell + 1])
            own = pc.fill_null(pc.index_in(names.slice(c, d - c), ids.slice(a, b - a)), -1)
            best = _nearest_of_bucket(
                docs[a:b], requests[c:d], own.to_numpy().astype(np.int64), reach[c:d], k
            )
            best["request"] += c
            best["doc"] += a
            hits.append(best)
        best = np.concatenate(hits) if hits else np.empty(0, HIT)
        return pa.table(
            [names.take(pa.array(best["request"])), ids.take(pa.array(best["doc"])), pa.array(best["dist"])],
            schema=out,
        )

    return run


def _split(rows: DataFrame, own: DataFrame, other: DataFrame, key: str, mine: str, theirs: str) -> DataFrame:
    """``rows`` dealt to one block of their side and copied to each of the other's."""
    counted = rows.join(own.withColumnRenamed("blocks", "own_blocks"), "cell", "left").join(
        other.withColumnRenamed("blocks", "other_blocks"), "cell", "left"
    )
    dealt = F.pmod(F.xxhash64(key), F.coalesce("own_blocks", F.lit(1)))
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("other_blocks", F.lit(1)) - 1)
    return counted.select(*rows.columns, dealt.cast("long").alias(mine), F.explode(copies).alias(theirs))


def _meet(placed: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Partial rankings of ``asked`` against the documents of their buckets."""

    def crowded(rows: DataFrame) -> DataFrame:
        blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        return blocks.filter("blocks > 1")

    docs, requests = crowded(placed), crowded(asked)
    left = _split(placed, docs, requests, "id", "db", "rb")
    right = _split(asked, requests, docs, "request_id", "rb", "db")
    pack = F.shiftright("cell", PACK_BITS).alias("pack")
    return (
        left.groupBy(pack, "db", "rb")
        .cogroup(right.groupBy(pack, "db", "rb"))
        .applyInArrow(_nearest_of_pack(k), FOUND)
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """``found`` without pairs met in several tables, the best ``k`` of each request."""
    once = found.repartition("request_id").groupBy("request_id", "id").agg(F.min("dist").alias("dist"))
    return top_k_per_key(once, ["request_id"], [F.col("dist"), F.col("id")], k)


def classes_of_equals(stored: DataFrame, keep: int) -> DataFrame:
    """``(vector, id, members)``: every distinct vector, its smallest id and its ``keep`` smallest."""
    first = top_k_per_key(stored.select("id", "vector"), ["vector"], [F.col("id")], keep)
    members = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return members.select("vector", F.col("members")[0].alias("id"), "members")


def hashed_neighbours(
    docs: DataFrame,
    k: int = settings.SEARCH_TOP_K,
    tables: int = TABLES,
    probes: int = PROBES,
    bits: int | None = None,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """``(request_id, id, dist, rank)``: about the ``k`` nearest others of every document.

    Distances are those of the exact search; some neighbours may be missed (see
    ``recall``). With ``seeds`` (a table with ``id``) only for those documents.
    """
    directed = F.exists("vector", lambda x: x != 0)
    stored = docs.filter(F.col("vector").isNotNull() & directed).select(
        F.col("id").cast("string").alias("id"), "vector"
    )
    classes = settle(classes_of_equals(stored, k + 1))
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    if bits is None:
        bits = max(0, round(math.log2(max(1, shape["n"]) / BUCKET)))
    planes = hyperplanes(shape["size"] or 1, tables, bits, seed)

    asked = stored if seeds is None else stored.join(seeds.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    owners = asked.withColumnRenamed("id", "request_id").join(
        classes.select("vector", F.col("id").alias("class_id")), "vector"
    )
    owners = settle(owners.select("request_id", "class_id"))
    wanted = classes.select("id", "vector").join(
        owners.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi"
    )
    requests = wanted.select(F.col("id").alias("request_id"), "vector", F.lit(math.inf).alias("reach"))

    # With no planes all tables are the same single bucket.
    tables = tables if bits else 1
    placed = settle(_place(classes.select("id", "vector"), planes[:, : tables * bits], tables, 1, 0))
    near = settle(_best(_meet(placed, _place(requests, planes, tables, 1, 0), k, block_rows), k))
    found = near.select("request_id", "id", "dist")
    if bits and probes > 1:
        full = near.groupBy("request_id").agg(F.max("dist").alias("last"), F.count(F.lit(1)).alias("n"))
        reach = full.select("request_id", F.when(F.col("n") >= k, F.col("last")).alias("last"))
        bounded = requests.join(reach, "request_id", "left").select(
            "request_id", "vector", F.coalesce("last", "reach").alias("reach")
        )
        further = _meet(placed, _place(bounded, planes, tables, probes, 1), k, block_rows)
        found = _best(found.unionByName(further), k).select("request_id", "id", "dist")

    # Put the members of the classes back: those of the own class are at distance 0.
    members = classes.select("id", "members")
    others = found.join(members, "id").select("request_id", "dist", F.explode("members").alias("id"))
    own = wanted.join(members, "id").select(
        F.col("id").alias("request_id"), F.lit(0.0).alias("dist"), F.explode("members").alias("id")
    )
    listed = top_k_per_key(others.unionByName(own), ["request_id"], [F.col("dist"), F.col("id")], k + 1)
    lists = listed.groupBy(F.col("request_id").alias("class_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "dist"))).alias("hits")
    )
    left = F.slice(F.filter("hits", lambda h: h["id"] != F.col("request_id")), 1, k)
    return (
        owners.join(lists, "class_id")
        .select("request_id", F.posexplode(left).alias("place", "hit"))
        .select("request_id", "hit.id", "hit.dist", (F.col("place") + 1).alias("rank"))
    )


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``(neighbours, found, recall)`` over the rows of ``exact``.

    An empty ``exact`` has a recall of null.
    """
    pairs = found.select("request_id", "id", F.lit(True).alias("hit"))
    met = exact.join(pairs, ["request_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")
    )
    return met.withColumn("recall", F.col("found") / F.nullif("neighbours", F.lit(0)))
