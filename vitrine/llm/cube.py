"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size gives every document of it the same expected
number of copies; the whole part is certain and the fraction is an inclusion
probability. The flight phase moves the probabilities of three documents at a
time along the null space of two balancing constraints (words, documents) until
one of them is decided. It runs in blocks of a bounded number of documents; the
at most two that stay undecided in a block go on to the next round, so rounds
grow with the logarithm of the largest source. What is left of a source at the
end, two documents, is the landing problem.

Defined results: null texts have size 0; a null source is a source of its own,
ranked last; rows agreeing in id and source are one unit and get the same
number of copies; with no words at all every target is 0 and nothing is taken.
Choices are seeded by source, block and round, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordinals import with_ordinals
from vitrine.session import settle

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
BLOCK = 4096
LARGEST = 64
EPS = 1e-9
# What a list of sources may hold to be broadcast.
BROADCAST_SOURCES = 100_000
BROADCAST_NAME_BYTES = 1 << 24

UNITS = "source string, id long, size double, chance double, block long"


def null_direction(a: float, b: float, c: float) -> tuple[float, float, float]:
    """A direction that changes neither the words nor the number of three documents."""
    u = (b - c, c - a, a - b)
    scale = max(abs(u[0]), abs(u[1]), abs(u[2]))
    return (1.0, -1.0, 0.0) if scale == 0 else (u[0] / scale, u[1] / scale, u[2] / scale)


def flight(size: np.ndarray, chance: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Decide all but at most two of the documents; sums of size and count stay as they are."""
    out = chance.copy()
    draws = rng.random_sample(len(out) + 3)
    held: list[int] = []
    for i in np.flatnonzero((out > EPS) & (out < 1 - EPS)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        u = null_direction(*(size[j] for j in held))
        up = min(((1 - out[j]) if d > 0 else out[j]) / abs(d) for j, d in zip(held, u) if d)
        down = min((out[j] if d > 0 else (1 - out[j])) / abs(d) for j, d in zip(held, u) if d)
        step = up if draws[i] * (up + down) < down else -down
        for j, d in zip(held, u):
            out[j] += step * d
        held = [j for j in held if EPS < out[j] < 1 - EPS]
    out[out <= EPS] = 0.0
    out[out >= 1 - EPS] = 1.0
    return out


def settle_largest(size: np.ndarray, chance: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Decide the largest documents first, against all the others at once.

    Moved three at a time, a document far larger than the rest hardly moves and
    would be left for the landing. Here the direction in the null space has one
    large document on one side and a small change of every other on the other.
    """
    out = chance.copy()
    for i in np.argsort(-size, kind="stable")[: min(LARGEST, len(size) // 2)].tolist():
        for _ in range(LARGEST):
            if not EPS < out[i] < 1 - EPS:
                break
            rest = (out > EPS) & (out < 1 - EPS)
            rest[i] = False
            room = out[rest] * (1 - out[rest])
            s = size[rest]
            m0, m1, m2 = room.sum(), (room * s).sum(), (room * s * s).sum()
            if m0 * m2 - m1 * m1 <= EPS * max(m0 * m2, EPS):
                break
            level, slope = np.linalg.solve([[m0, m1], [m1, m2]], [1.0, size[i]])
            u = np.zeros(len(out))
            u[rest] = -room * (level + slope * s)
            u[i] = 1.0
            moved = np.flatnonzero(u)
            above, below = 1 - out[moved], out[moved]
            d = u[moved]
            up = (np.where(d > 0, above, below) / np.abs(d)).min()
            down = (np.where(d > 0, below, above) / np.abs(d)).min()
            step = up if rng.random_sample() * (up + down) < down else -down
            out[moved] = np.clip(out[moved] + step * d, 0.0, 1.0)
    return out


def landing(size: np.ndarray, chance: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Decide the last one or two, keeping their probabilities, with the least expected miss."""
    out = chance.copy()
    left = np.flatnonzero((out > 0) & (out < 1)).tolist()
    if len(left) == 2:
        p, q = out[left[0]], out[left[1]]
        together = (max(0.0, p + q - 1), min(p, q))

        def miss(both: float) -> float:
            cases = ((1, 1, both), (1, 0, p - both), (0, 1, q - both), (0, 0, 1 - p - q + both))
            return sum(
                w * ((x - p) * size[left[0]] + (y - q) * size[left[1]]) ** 2 for x, y, w in cases
            )

        both = min(together, key=miss)
        draw = rng.random_sample()
        out[left[0]] = float(draw < p)
        out[left[1]] = float(draw < both or p <= draw < p + q - both)
    elif left:
        out[left[0]] = float(rng.random_sample() < out[left[0]])
    return out


def decide(round_no: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight of one block, and the landing where the block is all of its source."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "order", "id"], ascending=[False, True, True], kind="stable")
        seed = (int(block["seed"].iloc[0]) ^ (round_no * 0x9E3779B1)) & 0xFFFFFFFF
        rng = np.random.RandomState(seed)
        size = block["size"].to_numpy()
        chance = flight(size, settle_largest(size, block["chance"].to_numpy(), rng), rng)
        if block["alone"].iloc[0]:
            chance = landing(size, chance, rng)
        return block.assign(chance=chance)[["source", "id", "size", "chance", "block"]]

    return one


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, stopped at ``most`` times.

    The excess of stopped sources is dealt to the others by weight until none is
    above. Only sums over the sources reach the driver.
    """
    ranked = with_ordinals(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("most")
        if stopped < 0:
            over = F.lit(False)
        n, held, free = ranked.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (share * total - held) / free
    return ranked.select(
        "source", "source_size", F.least(F.col("weight") * level, F.col("most")).alias("target")
    )


def per_source(
    sources: DataFrame, rows: int = BROADCAST_SOURCES, name_bytes: int = BROADCAST_NAME_BYTES
) -> DataFrame:
    """A table of one row per source, to be joined to the rows of the sources.

    Broadcast while its counted size allows, so that a source with a large share
    of all rows stays dealt over the tasks that hold them. A longer list of
    sources is shuffled, where adaptive execution splits the skewed ones.
    """
    n, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(sources) if n <= rows and size <= name_bytes else sources


def mix(
    docs: DataFrame,
    size: Column,
    id_column: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    block: int = BLOCK,
) -> DataFrame:
    """Copies of every unit: (id, source, size, source_size, target, copies).

    One row per input row; ``size`` is the row's own number of words.
    """
    rows = settle(
        docs.select(
            F.col(id_column).cast("long").alias("id"),
            F.col(source).cast("string").alias("source"),
            size.cast("long").alias("size"),
        )
    )
    sums = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    targets = settle(source_targets(sums.select("source", "source_size"), weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = settle(
        targets.alias("t")
        .join(sums.select("source", "n").alias("s"), F.expr("t.source <=> s.source"))
        .select(
            "t.source",
            "t.source_size",
            "t.target",
            F.floor(ratio + EPS).alias("whole"),
            F.greatest(ratio - F.floor(ratio + EPS), F.lit(0.0)).alias("chance"),
            F.greatest(F.ceil(F.col("n") / block), F.lit(1)).alias("blocks"),
        )
    )
    units = rows.groupBy("source", "id").agg(F.sum("size").cast("double").alias("size"))
    open_units = (
        units.alias("u")
        .join(per_source(plan).alias("p"), F.expr("u.source <=> p.source"))
        .select("u.source", "u.id", "u.size", "p.chance", "p.blocks")
    )
    decided: DataFrame | None = None
    round_no = 0
    while True:
        flown = settle(
            open_units.withColumn("order", F.xxhash64("id", F.lit(round_no)))
            .withColumn("block", F.pmod("order", F.col("blocks")))
            .withColumn("alone", F.col("blocks") == 1)
            .withColumn("seed", F.xxhash64("source", "block"))
            .groupBy("source", "block")
            .applyInPandas(decide(round_no), UNITS)
        )
        done = flown.filter("chance in (0, 1)").select("source", "id", "chance")
        decided = done if decided is None else decided.unionByName(done)
        rest = flown.filter("chance not in (0, 1)").select("source", "id", "size", "chance")
        left = settle(rest.groupBy("source").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias("blocks")))
        if left.isEmpty():
            break
        open_units = (
            rest.alias("u")
            .join(per_source(left).alias("l"), F.expr("u.source <=> l.source"))
            .select("u.source", "u.id", "u.size", "u.chance", "l.blocks")
        )
        round_no += 1
    return (
        rows.alias("r")
        .join(decided.alias("d"), F.expr("r.source <=> d.source and r.id <=> d.id"))
        .join(per_source(plan).alias("p"), F.expr("r.source <=> p.source"))
        .select(
            "r.id",
            "r.source",
            "r.size",
            "p.source_size",
            "p.target",
            (F.col("p.whole") + F.col("d.chance")).cast("long").alias("copies"),
        )
    )


def word_count(text: str) -> Column:
    """Words between blanks; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents of the mix with ``copies`` of each, its size and its source's target."""
    chosen = (
        mix(docs, word_count(text), id_column, source)
        .filter("copies > 0")
        .groupBy("id", "source")
        .agg(F.first("copies").alias("copies"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    )
    plain = docs.drop("copies", "size", "source_size", "target")
    return (
        plain.alias("d")
        .join(chosen.alias("c"), F.col(f"d.{id_column}").eqNullSafe(F.col("c.id")) & F.col(f"d.{source}").eqNullSafe(F.col("c.source")))
        .select("d.*", "c.copies", word_count(text).alias("size"), "c.source_size", "c.target")
    )
