"""Substring look-ups of query tokens through an inverted index of text runs.

A token is a run of letters and digits, so a text contains it exactly where one
of the text's own runs does. Tokens therefore never meet texts: they meet the
distinct runs of the vocabulary, by equality on one short gram of the token,
and only runs that hold the token go on to the documents that hold the run. As
long as these pairs are few they go to where the documents are read, so that the
words of all texts are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import tokens
from vitrine.session import broadcast_if_small, settle

# Up to so many tokens are looked for in the words themselves before these are passed on.
FEW_TOKENS = 128
# Grams of this length stand for a token; a shorter token is its own gram.
GRAM = 3


def grams(word: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    found = F.transform(places, lambda p: F.substring(word, p, F.lit(size)))
    return F.when(F.length(word) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def matching_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(token, run)`` of every distinct ``run`` that contains a distinct ``token``.

    A token is looked up by its rarest gram, so a common one costs only where a
    token has no other.
    """
    short = grams(F.col("run"), GRAM - 1)
    of_runs = runs.select("run", F.explode(F.concat(short, grams(F.col("run"), GRAM))).alias("gram"))
    asked = wanted.select(
        "token",
        F.explode(
            F.when(F.length("token") < GRAM, F.array("token")).otherwise(grams(F.col("token"), GRAM))
        ).alias("gram"),
    )
    # Grams of all runs are many; only those asked for are counted, where the runs lie.
    known = broadcast_if_small(settle(asked.select("gram").distinct()))
    frequent = of_runs.join(known, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no run has rules its token out.
    rarest = (
        asked.join(frequent, "gram", "left")
        .groupBy("token")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    )
    rarest = broadcast_if_small(settle(rarest))
    return (
        of_runs.join(rarest, "gram").filter(F.contains("run", "token")).select("token", "run")
    )


def with_a_token(runs: Column, wanted: DataFrame) -> Column:
    """``runs`` (an array) without those that hold none of the ``wanted`` tokens, if these are few."""
    found = [r["token"] for r in wanted.limit(FEW_TOKENS + 1).collect()]
    if not found or len(found) > FEW_TOKENS:
        return runs
    # What holds a longer token holds the shorter one within it; tokens are letters and digits.
    shortest = sorted(t for t in found if not any(o in t for o in found if o != t))
    return F.filter(runs, lambda run: F.rlike(run, F.lit("|".join(shortest))))


def token_hits(
    texts: DataFrame, wanted: DataFrame, titles: str | None = None, category: str | None = None
) -> DataFrame:
    """``(token, id, in_title, is_category)`` of every text that contains a token of ``wanted``, with the other columns of ``texts``.

    ``texts`` holds a unique ``id`` and lower-case ``low_text``; with ``titles``
    the column of that name is a part of the text whose matches are marked, with
    ``category`` the matches of tokens that are that column's whole value.
    """
    carried = [c for c in texts.columns if c not in ("id", "low_text", titles, category)]
    held = tokens(F.col(titles)) if titles else F.array().cast("array<string>")
    label = F.col(category) if category else F.lit(None).cast("string")
    asked = settle(wanted.select("token").distinct())
    postings = texts.select(
        "id", *carried, label.alias("category_run"), held.alias("title_runs"), F.explode(with_a_token(F.array_distinct(tokens(F.col("low_text"))), asked)).alias("run")
    ).withColumn("in_title", F.array_contains("title_runs", F.col("run")))
    runs = settle(postings.select("run").distinct())
    found = broadcast_if_small(settle(matching_runs(runs, asked)))
    return (
        postings.drop("title_runs")
        .join(found, "run")
        .withColumn("is_category", F.col("category_run") == F.col("token"))
        # Marks and numbers only, which are summed up in a hash table; texts would be sorted.
        .groupBy("token", "id")
        .agg(
            F.max("in_title").alias("in_title"),
            F.max("is_category").alias("is_category"),
            *(F.max(c).alias(c) for c in carried),
        )
    )
