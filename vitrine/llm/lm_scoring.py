"""Scoring documents with a recurrent language model trained on the corpus.

1. Words of the training documents are counted, all of them, in Spark.
2. The most frequent ``vocabulary`` words are the model's own; the counts of the
   ``head`` most frequent travel to the tasks (both bounds are parameters). The
   counts of all other words stay a table and meet the documents in a join.
3. The model is trained on every training document: in each round every task
   trains a copy on its share of the texts, and the copies are averaged, weighted
   by their words, in two levels of sums by parameter block. Rounds take growing
   disjoint shares that together are the whole training set.
4. Every text is scored whole. A word outside the vocabulary has the probability
   of the class of such words times its smoothed share among them, from the
   corpus counts.

Rare words are joined by a 64-bit hash. Defined results: null texts are empty
and consist of the end alone; repeated rows are scored alike; without training
documents every word has the unseen word's probability, 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.frames import ROW, numbered
from vitrine.llm.recurrent import Model, Trainer, fresh, score
from vitrine.llm.texts import LOWER, lists, signed, text_slices
from vitrine.session import settle

VOCABULARY = 4096
SPAN = 64
HEAD = 1 << 18
# Shares of the training documents in each round, in 32nds.
ROUNDS = (2, 10, 20)
BLOCKS = 64
FLUSH = 1 << 18
SCORE_BYTES = 4 << 20
END = b"\n"
SEED = 42


def split_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
    whole = LOWER[data].tobytes()
    ends = offsets.tolist()
    for a, b in zip(ends, ends[1:]):
        yield whole[a:b].split()


def numbered_words(
    data: np.ndarray, offsets: np.ndarray, numbers: dict[bytes, int], missing: int, end: int
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words of a slice, ``end`` after each row's; first of each row; the words."""
    words: list[bytes] = []
    first = [0]
    for own in split_rows(data, offsets):
        words += own
        words.append(END)
        first.append(len(words))
    ids = np.fromiter(map(numbers.get, words, repeat(missing)), np.int64, len(words))
    first = np.array(first)
    ids[first[1:] - 1] = end
    return ids, first, words


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words met, given out whenever many have gathered."""
    counts: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"],
        )

    for _rows, data, offsets in text_slices(batches, "text"):
        for words in split_rows(data, offsets):
            counts.update(words)
        counts[END] += len(offsets) - 1
        if len(counts) > FLUSH:
            yield flushed()
            counts.clear()
    if counts:
        yield flushed()


@dataclass
class Corpus:
    """Counts that every task gets: the head's words and logs, and sums over all words."""

    head: bytes  # joined by zero bytes and blanks, most frequent first
    counts: np.ndarray
    tokens: int
    distinct: int
    vocabulary: int

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head.split(b"\x00 "))} if len(self.counts) else {}

    def own_numbers(self) -> dict[bytes, int]:
        """Only those of the model's words."""
        return {w: i for i, w in enumerate(self.head.split(b"\x00 ", self.vocabulary)[: self.vocabulary])}

    def end_number(self) -> int:
        return self.numbers().get(END, self.vocabulary)

    def others(self) -> tuple[int, int]:
        """Tokens and distinct words outside the vocabulary."""
        return self.tokens - int(self.counts[: self.vocabulary].sum()), self.distinct - self.vocabulary


def corpus_of(counts: DataFrame, head: int, vocabulary: int) -> Corpus:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()
    words = [w.encode() for w in top.column("word").to_pylist()]
    # The end is always among the model's words.
    found = top.column("n").to_numpy().astype(np.int64)
    size = min(vocabulary, len(words))
    if words and END not in words[:size]:
        n_end = counts.filter(F.col("word") == END.decode()).first()["n"]
        at = words.index(END) if END in words else len(words)
        words = [w for w in words if w != END]
        found = np.delete(found, at) if at < len(found) else found
        words.insert(size - 1, END)
        found = np.insert(found, size - 1, n_end)
    return Corpus(b"\x00 ".join(words), found, int(tokens), int(distinct), size)


def trained_copy(flat: bytes, shape: Model, corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's parameters after its texts, times its tokens, in blocks."""
    numbers, unknown = corpus.own_numbers(), corpus.vocabulary

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = numbers.get(END, unknown)
        part = pyspark.TaskContext.get().partitionId()
        trainer = Trainer(shape.with_packed(np.frombuffer(flat, np.float32).copy()), part)
        for _rows, data, offsets in text_slices(batches, "text"):
            ids, first, _words = numbered_words(data, offsets, numbers, unknown, end)
            marks = np.zeros(len(ids), bool)
            marks[first[:-1]] = True
            trainer.train(ids, marks, end)
        if trainer.tokens:
            blocks = np.array_split(trainer.model.packed() * np.float32(trainer.tokens), BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(BLOCKS, dtype=np.int32)),
                    pa.array([part] * BLOCKS, pa.int32()),
                    pa.array([float(trainer.tokens)] * BLOCKS),
                    pa.array([b.astype(np.float32).tobytes() for b in blocks], pa.binary()),
                ],
                ["block", "part", "weight", "values"],
            )

    return train


BLOCK_SCHEMA = "block int, part int, weight double, values binary"


def summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["values"].iloc[0]) // 4, np.float64)
    for values in rows["values"]:
        total += np.frombuffer(values, np.float32)
    return pd.DataFrame(
        {
            "block": [rows["block"].iloc[0]],
            "part": [0],
            "weight": [rows["weight"].sum()],
            "values": [total.astype(np.float32).tobytes()],
        }
    )


def averaged(copies: DataFrame) -> np.ndarray | None:
    """The mean of all copies by weight; only one set of parameters reaches the driver."""
    some = copies.withColumn("_set", F.col("part") % 64).groupBy("block", "_set").applyInPandas(
        lambda rows: summed(rows.drop(columns="_set")), BLOCK_SCHEMA
    )
    blocks = some.groupBy("block").applyInPandas(summed, BLOCK_SCHEMA).collect()
    if not blocks:
        return None
    ordered = sorted(blocks, key=lambda r: r.block)
    return np.concatenate([np.frombuffer(r["values"], np.float32) / r.weight for r in ordered])


def trained(texts: DataFrame, corpus: Corpus, rounds: tuple[int, ...] = ROUNDS) -> Model:
    """Rounds of local training and averaging over all ``texts`` (id, text)."""
    counts = corpus.counts[: corpus.vocabulary]
    model = fresh(counts, corpus.others()[0], SPAN)
    share = F.pmod(F.xxhash64("id", "text"), F.lit(sum(rounds)))
    low = 0
    for width in rounds:
        own = texts.filter((share >= low) & (share < low + width)).select("text")
        low += width
        copies = own.mapInArrow(trained_copy(model.packed().tobytes(), model, corpus), BLOCK_SCHEMA)
        flat = averaged(copies)
        if flat is not None:
            model = model.with_packed(flat)
    return model


SCORED = (
    "id long, n_tokens long, n_known long, head_logs double, model_log double, "
    "n_others long, other_logs double, rare array<struct<word: long, n: int>>"
)


def scorer(model: Model, corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, unknown = corpus.numbers(), corpus.vocabulary
        end = numbers.get(END, unknown)
        logs = np.append(np.log10(corpus.counts + 1.0), 0.0)
        for rows, data, offsets in text_slices(batches, "text", SCORE_BYTES):
            ids, first, words = numbered_words(data, offsets, numbers, -1, end if len(numbers) else -1)
            own = np.where((ids < 0) | (ids > unknown), unknown, ids).astype(np.int32)
            # The last log, 0, stands for the words that are not in the head.
            log = logs[ids]
            other = (ids < 0) | (ids >= unknown)
            missing = ids < 0
            missing[first[1:] - 1] = False
            rare_at = np.flatnonzero(missing)
            digest = xxhash.xxh64_intdigest
            marks = np.array([digest(words[i], SEED) for i in rare_at.tolist()], np.uint64)
            # The words are not kept while the model runs.
            del words
            total = score(model, np.split(own, first[1:-1]), end)
            row = np.searchsorted(first, rare_at, "right") - 1
            order = np.lexsort((marks, row))
            marks, row = marks[order], row[order]
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(marks)))
            rare = pa.StructArray.from_arrays(
                [pa.array(signed(marks[at])), pa.array(times.astype(np.int32))], ["word", "n"]
            )
            sums = lambda values: np.add.reduceat(values, first[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    pa.array(np.diff(first)),
                    pa.array(sums((ids >= 0).astype(np.int64))),
                    pa.array(sums(log)),
                    pa.array(total),
                    pa.array(sums(other.astype(np.int64))),
                    pa.array(sums(np.where(other, log, 0.0))),
                    lists(rare, np.bincount(row[at], minlength=len(first) - 1)),
                ],
                ["id", "n_tokens", "n_known", "head_logs", "model_log", "n_others", "other_logs", "rare"],
            )

    return run


def language_scores(
    docs: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text: str = "text",
    vocabulary: int = VOCABULARY,
    head: int = HEAD,
) -> DataFrame:
    """Per document (``training`` is a condition on ``id``): id, n_tokens, n_known, train_tokens,
    base_score (add-one word frequencies) and score, both log10 of the text's probability."""
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    texts = plain.filter(training)
    counts = settle(
        texts.select("text").mapInArrow(partial_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    corpus = corpus_of(counts, head, vocabulary)
    model = trained(texts, corpus)
    scored = numbered(plain.mapInArrow(scorer(model, corpus), SCORED))
    # Counts of the rare words; a word that no training document has adds nothing.
    rare = scored.select(ROW, F.explode("rare").alias("w")).select(ROW, "w.word", "w.n")
    known = counts.select(F.xxhash64("word").alias("word"), F.col("n").alias("c")).groupBy("word").agg(F.sum("c").alias("c"))
    sums = (
        rare.join(known, "word")
        .groupBy(ROW)
        .agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    )
    n_other, distinct_other = corpus.others()
    base = float(np.log10(corpus.tokens + corpus.distinct + 1))
    other = float(np.log10(n_other + distinct_other + 1))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(sums, ROW, "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("head_logs") + rare_logs - F.col("n_tokens") * base).alias("base_score"),
        (
            F.col("model_log") / float(np.log(10)) + F.col("other_logs") + rare_logs - F.col("n_others") * other
        ).alias("score"),
    )
