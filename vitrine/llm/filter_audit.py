"""What each of several filters removes, in every order, by Hart-Mas-Colell potentials.

Filters are players of a removal game: a coalition is worth the documents that
fail at least one of its filters. One grouped count by part and set of failed
filters holds everything the game needs, at most 2^n rows a part, so no
document is looked at once an order. The potential of a coalition is its worth
plus the potentials of the coalitions one filter smaller, over its size; a
filter's Shapley value is the grand potential less the potential without it.
A step of an order removes the difference of two coalitions' worths.

Defined results: a null text is empty; a null part is the empty string; rows
agreeing in id count once each; of identical texts those with the smallest id
pass the duplicate filter, and a row without an id always does and has no
labels; a document is good (toxic) if any of its label rows says 1; without
documents there are no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import settle

Test = Callable[[Column], Column]

BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


# Each is true where a text fails. Numbers and characters are fixed values.
FILTERS: dict[str, Test] = {
    "A": lambda text: F.size(words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(words(text))) < 50 * F.size(words(text)),
    "C": lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
DUPLICATES = "E"


def _bits(tests: list[Column]) -> Column:
    marks = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    return reduce(Column.bitwiseOR, marks, F.lit(0))


def failed_sets(
    documents: DataFrame,
    filters: dict[str, Test],
    part: str = "lang",
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``(part, id, failed)`` of every document; the bit after those of ``filters`` marks later copies."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = settle(
        documents.select(
            F.coalesce(F.col(part), F.lit("")).alias("part"),
            F.col(key).alias("id"),
            _bits([test(body) for test in filters.values()]).alias("failed"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
        )
    )
    # Combined before the shuffle, so a text with very many copies is one row a task here. Rows meet
    # their group's first by an outer join, whose hot digests adaptive execution splits.
    firsts = (
        slim.groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return slim.join(firsts, "digest", "left").select(
        "part", "id", F.col("failed").bitwiseOR(F.when(later, 1 << len(filters)).otherwise(0)).alias("failed")
    )


def labelled(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(id, good, toxic)`` as 0 or 1, one row an id that has either."""
    marks = labels.groupBy(F.col(key).alias("id")).agg(
        *(
            F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(name)
            for c, name in (("quality", "good"), ("toxic", "toxic"))
        )
    )
    return marks.filter("good = 1 or toxic = 1")


COUNTS = ("n", "good", "toxic")


def games(failed: DataFrame, labels: DataFrame, players: int) -> DataFrame:
    """``(part, total, n, good, toxic)``: worths of all coalitions by their bits, as arrays of 2^players."""
    known = failed.join(labels, "id", "left")
    counts = known.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[1:]),
    )
    every = F.sequence(F.lit(0), F.lit((1 << players) - 1))
    removed = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    worths = (
        counts.withColumn("coalition", F.explode(every))
        .groupBy("part", "coalition")
        .agg(
            F.sum("n").alias("total"),
            *(F.sum(F.when(removed, F.col(c)).otherwise(0)).alias(c) for c in COUNTS),
        )
    )
    # One row a coalition: the lists are of fixed length.
    listed = F.sort_array(F.collect_list(F.struct("coalition", *COUNTS)))
    return (
        worths.groupBy("part")
        .agg(F.max("total").alias("total"), listed.alias("w"))
        .select("part", "total", *(F.col(f"w.{c}").alias(c) for c in COUNTS))
    )


def potentials(worth: Column, players: int) -> Column:
    """Potentials of all coalitions by their bits, times players! so that they are whole numbers."""
    scale = factorial(players)

    def next_one(held: Column, coalition: Column) -> Column:
        smaller = [
            F.when(coalition.bitwiseAND(1 << i) != 0, F.get(held, coalition.bitwiseXOR(F.lit(1 << i)))).otherwise(0)
            for i in range(players)
        ]
        total = reduce(Column.__add__, smaller, F.get(worth, coalition) * scale)
        # The sum is a multiple of the size: players! times a potential is whole.
        return F.concat(held, F.array(F.call_function("div", total, F.bit_count(coalition))))

    empty = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), empty, next_one)


def audit(
    documents: DataFrame,
    labels: DataFrame,
    filters: dict[str, Test] = FILTERS,
    duplicates: str = DUPLICATES,
    part: str = "lang",
) -> DataFrame:
    """One row a part, order of all filters and step, with what the step's filter does there.

    ``shapley`` is the filter's Shapley value times the number of orders.
    """
    letters = "".join(filters) + duplicates
    players = len(letters)
    full = (1 << players) - 1
    played = games(failed_sets(documents, filters, part), labelled(labels), players).withColumn(
        "potential", potentials(F.col("n"), players)
    )
    orders = ["".join(p) for p in permutations(letters)]

    def bits(of: Column) -> Column:
        return reduce(
            Column.__add__,
            (F.when(of.contains(letter), 1 << i).otherwise(0) for i, letter in enumerate(letters)),
        )

    steps = (
        played.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(players))))
        .withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
        .withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))
        .withColumn("after", F.col("before") + F.col("own"))
    )
    without = F.lit(full) - F.col("own")

    def worth(c: str, coalition: Column | str) -> Column:
        return F.get(F.col(c), F.col(coalition) if isinstance(coalition, str) else coalition)

    def lost(c: str) -> Column:
        return worth(c, "after") - worth(c, "before")

    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - worth("n", "after")).alias("kept"),
        lost("n").alias("removed"),
        (worth("n", "own") - lost("n")).alias("redundant"),
        (worth("n", F.lit(full)) - worth("n", without)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (worth("potential", F.lit(full)) - worth("potential", without)).alias("shapley"),
    )
