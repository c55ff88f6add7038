"""How the terms of each source differ from those of its language's other sources.

Single-pass in-memory indexing: a task counts terms in memory, and when its
block is full writes the block out as runs sorted by term, one to each hash
shard. A shard's runs meet in one task as short chunks, which Spark's sorter
merges (its spills over a heap) into the order of their first terms; postings
of equal terms are summed as soon as no chunk to come can hold the term, so
only overlapping chunks are open. No term has more than one posting a block and
group, so a frequent term is no hot key.

A term that a source does not use still has a share there, the same for all
such terms. Pairs of sources are therefore summed as if no term were common to
both, from counts of equal shares, and then corrected by the terms that are:
these stream by, term by term, into sums a pair. A language's list of pairs is
as long as its number of sources squared; nothing else is.

Defined results: null texts, languages and sources are empty; rows are
documents of their own, also where ids repeat; a language without kept terms
has values of 0; without documents there are no rows. Other columns of the
input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.texts import LOWER, lists
from vitrine.operators.topk import top_k_per_key
from vitrine.session import settle

# Letters, as bytes: every byte of a character beyond ASCII is one.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# What a block may hold, and what an entry of it takes beside its term.
BLOCK_BYTES = 48 << 20
ENTRY_BYTES = 240
SCAN_BYTES = 1 << 20
CHUNK_POSTINGS = 512
# Occurrences below, documents above this bit.
DOCUMENT_SHIFT = 40
ONE_DOCUMENT = 1 << DOCUMENT_SHIFT
CHUNKS_OUT = 128
STRETCH_POSTINGS = 1 << 17
PAIRS_AT_ONCE = 1 << 19
PAIRS_HELD = 1 << 20

RUNS = "shard int, lang string, first binary, terms array<binary>, sources array<string>, counts array<long>, documents array<long>"
FREQUENCIES = "lang string, term string, source string, count long, lang_count long, leads boolean"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case terms of a text, a bounded stretch at a time; a term is not cut."""
    low = 0
    while low < len(text):
        high = low + SCAN_BYTES
        if high < len(text) and (rest := TERM.match(text, high)):
            high = rest.end()
        yield TERM.findall(text[low:high].translate(LOWER.tobytes()))
        low = high


class Block:
    """Occurrences and documents of terms by (lang, source), both in one number a term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], dict[bytes, int]] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        found: Counter = Counter()
        for terms in term_lists(text):
            found.update(terms)
        group = self.groups.setdefault((lang, source), {})
        before = len(group)
        size = group.get
        for term, count in found.items():
            group[term] = size(term, 0) + count + ONE_DOCUMENT
        new = len(group) - before
        # New terms are those put in last.
        self.held += ENTRY_BYTES * new + sum(map(len, islice(reversed(group), new)))

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as term-sorted runs, one a shard and language, in chunks."""
        by_lang: dict[str, list[tuple[str, dict[bytes, int]]]] = {}
        for (lang, source), group in self.groups.items():
            by_lang.setdefault(lang, []).append((source, group))
        self.groups, self.held = {}, 0
        for lang, held in by_lang.items():
            if any(group for _s, group in held):
                yield from _chunks(lang, held, shards)


def _chunks(lang: str, held: list[tuple[str, dict[bytes, int]]], shards: int) -> Iterator[pa.RecordBatch]:
    terms = [term for _s, group in held for term in group]
    both = np.fromiter((n for _s, group in held for n in group.values()), np.int64, len(terms))
    shard = np.fromiter((zlib.crc32(term) % shards for term in terms), np.int32, len(terms))
    owner = np.repeat(np.arange(len(held)), [len(group) for _s, group in held])
    names = pa.array([source for source, _g in held], pa.string())
    table = pa.table({"shard": shard, "term": pa.array(terms, pa.binary())})
    order = pc.sort_indices(table, [("shard", "ascending"), ("term", "ascending")])
    place = order.to_numpy()
    shard, both = shard[place], both[place]
    sorted_terms = table.column("term").combine_chunks().take(order)
    # A chunk ends with its shard or when it is full.
    begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    within = np.arange(len(shard)) - np.repeat(begin, np.diff(np.append(begin, len(shard))))
    first = np.flatnonzero(within % CHUNK_POSTINGS == 0)
    columns = [
        sorted_terms,
        names.take(pa.array(owner[place])),
        pa.array(both & (ONE_DOCUMENT - 1)),
        pa.array(both >> DOCUMENT_SHIFT),
    ]
    for low in range(0, len(first), CHUNKS_OUT):
        starts = first[low : low + CHUNKS_OUT]
        end = first[low + CHUNKS_OUT] if low + CHUNKS_OUT < len(first) else len(shard)
        sizes = np.diff(np.append(starts, end))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard[starts]),
                pa.array([lang] * len(starts), pa.string()),
                sorted_terms.take(pa.array(starts)),
                *(lists(c.slice(starts[0], end - starts[0]), sizes) for c in columns),
            ],
            names=["shard", "lang", "first", "terms", "sources", "counts", "documents"],
        )


def _index(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for row in range(batch.num_rows):
                block.add(langs[row], sources[row], texts[row].as_py())
                if block.held > BLOCK_BYTES:
                    yield from block.runs(shards)
        yield from block.runs(shards)

    return run


POSTINGS = ["term", "source", "count", "documents"]


def _kept(lang: str, postings: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Frequencies of the terms that ``least`` documents hold, all their postings given."""
    sums = [("count", "sum"), ("documents", "sum")]
    terms = postings.group_by("term", use_threads=False).aggregate(sums)
    terms = terms.filter(pc.greater_equal(terms.column("documents_sum"), least))
    place = pc.index_in(postings.column("term"), value_set=terms.column("term").combine_chunks())
    postings = postings.append_column("place", place).filter(pc.is_valid(place))
    found = postings.group_by(["place", "source"], use_threads=False).aggregate([("count", "sum")])
    place = found.column("place").to_numpy()
    leads = np.zeros(len(place), bool)
    leads[np.unique(place, return_index=True)[1]] = True
    yield from pa.table(
        [
            pa.array([lang] * len(place), pa.string()),
            terms.column("term").take(pa.array(place)).cast(pa.string()),
            found.column("source"),
            found.column("count_sum"),
            terms.column("count_sum").take(pa.array(place)),
            pa.array(leads),
        ],
        names=["lang", "term", "source", "count", "lang_count", "leads"],
    ).to_batches()


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequencies from chunks that come in the order of lang and first term.

    Chunks are opened a stretch at a time. No later one reaches below the first
    term of the last one opened, so terms below it are complete.
    """
    at: str | None = None
    held: list[pa.Table] = []
    for batch in batches:
        langs, firsts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        upto = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())
        low = 0
        while low < batch.num_rows:
            if langs[low] != at:
                if held:
                    yield from _kept(at, pa.concat_tables(held), least)
                at, held = langs[low], []
            before = upto[low - 1] if low else 0
            high = max(int(np.searchsorted(upto, before + STRETCH_POSTINGS, "right")), low + 1)
            while langs[high - 1] != at:
                high -= 1
            opened = [batch.column(c).slice(low, high - low).flatten() for c in range(3, 7)]
            held.append(pa.table(opened, names=POSTINGS))
            together = pa.concat_tables(held)
            below = pc.less(together.column("term"), firsts[high - 1])
            yield from _kept(at, together.filter(below), least)
            held = [together.filter(pc.invert(below))]
            low = high
    if held:
        yield from _kept(at, pa.concat_tables(held), least)


def frequencies(documents: DataFrame, least: int = MIN_DOCUMENTS, shards: int | None = None) -> DataFrame:
    """``(lang, term, source, count, lang_count, leads)`` of terms in ``least`` documents of their language.

    ``documents`` holds lang, source and text without nulls. ``leads`` is true
    in one row a term and language.
    """
    shards = shards or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = documents.select("lang", "source", "text").mapInArrow(_index(shards), RUNS)
    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "first")
    return dealt.mapInArrow(lambda batches: merged(batches, least), FREQUENCIES)


def share(count: Column, total: Column, terms: Column) -> Column:
    """A smoothed share in whole parts of ``SCALE``, from 1 up; exact for any count."""
    more, size = count + 1, F.greatest(total + terms, F.lit(1))
    narrow = F.call_function("div", more * F.lit(SCALE).cast("long"), size)
    wide = F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * more.cast("decimal(20,0)"), size.cast("decimal(20,0)")
    )
    return F.when(more < SCALE, narrow).otherwise(wide) + 1


def excess(p: Column, q: Column) -> Column:
    """A term's part of the divergence of shares ``p`` from ``q``."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups(documents: DataFrame, counted: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, terms, rest)``; ``rest`` is the share of a term it does not use."""
    sizes = counted.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    whole = counted.groupBy("lang").agg(
        F.sum("count").alias("lang_total"), F.sum(F.col("leads").cast("long")).alias("terms")
    )
    every = documents.select("lang", "source").distinct()
    held = every.join(sizes, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    return settle(held.withColumn("rest", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))


class PairSums:
    """Exact sums by a pair of group numbers, in sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(keys):
            self.parts.append(_summed(keys, values))
            self.held += len(self.parts[-1][0])
        if self.held > 2 * PAIRS_HELD:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, values = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = [_summed(keys, values)]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what terms common to two sources change, in one task's terms.

    Rows (lang, term, source, share, rest) come sorted by lang and term.
    """
    names: list[tuple[str, str]] = []
    numbers: dict[tuple[str, str], int] = {}
    sums = PairSums()

    def written() -> Iterator[pa.RecordBatch]:
        keys, values = sums.compact()
        for low in range(0, len(keys), 8192):
            left, right = keys[low : low + 8192] >> 32, keys[low : low + 8192] & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i][0] for i in left.tolist()], pa.string()),
                    pa.array([names[i][1] for i in left.tolist()], pa.string()),
                    pa.array([names[i][1] for i in right.tolist()], pa.string()),
                    pa.array(values[low : low + 8192]),
                ],
                names=["lang", "source", "item", "value"],
            )

    def number(table: pa.Table) -> np.ndarray:
        found = []
        for name in zip(table.column("lang").to_pylist(), table.column("source").to_pylist()):
            if name not in numbers:
                numbers[name] = len(names)
                names.append(name)
            found.append(numbers[name])
        return np.asarray(found, np.int64)

    def met(table: pa.Table, first: np.ndarray) -> None:
        """All pairs of rows of one term, so many rows at a time."""
        who = number(table)
        p, rest = (table.column(c).to_numpy() for c in ("share", "rest"))
        sizes = np.diff(np.append(first, table.num_rows))
        begin, k = np.repeat(first, sizes), np.repeat(sizes, sizes)
        upto = np.cumsum(k)
        low = 0
        while low < len(k):
            before = upto[low - 1] if low else 0
            high = max(int(np.searchsorted(upto, before + PAIRS_AT_ONCE, "right")), low + 1)
            rows = np.arange(low, high)
            left = np.repeat(rows, k[rows])
            right = np.arange(len(left)) - np.repeat(upto[rows] - k[rows] - before, k[rows]) + begin[left]
            other = left != right
            left, right = left[other], right[other]
            value = (
                _excess(p[left], p[right])
                - _excess(p[left], rest[right])
                - _excess(rest[left], p[right])
                + _excess(rest[left], rest[right])
            )
            sums.add(who[left] << 32 | who[right], value)
            low = high

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        changes = [
            pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)).to_numpy()
            for c in ("lang", "term")
        ]
        first = np.append(0, np.flatnonzero(changes[0] | changes[1]) + 1)
        # The last term may go on in the next batch.
        met(table.slice(0, first[-1]), first[:-1])
        held = table.slice(first[-1])
        if sums.held > PAIRS_HELD:
            yield from written()
            sums.parts, sums.held = [], 0
    if held is not None:
        met(held, np.zeros(1, np.int64))
    yield from written()


def pair_values(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: divergence of each source from each other one of its language."""
    other = sizes.select("lang", F.col("source").alias("item"), F.col("rest").alias("item_rest"))
    apart = F.col("source") != F.col("item")
    rest, item_rest = F.col("rest"), F.col("item_rest")
    none = (
        sizes.join(other, "lang")
        .filter(apart)
        .select("lang", "source", "item", (F.col("terms") * excess(rest, item_rest)).alias("value"))
    )
    # Terms of one source with one share differ from the others' rest alike.
    equal = counted.groupBy("lang", "source", "share", "rest").agg(F.count(F.lit(1)).alias("n"))
    p, n = F.col("share"), F.col("n")
    one = (
        equal.join(other, "lang")
        .filter(apart)
        .groupBy("lang", "source", "item")
        .agg(
            F.sum(n * (excess(p, item_rest) - excess(rest, item_rest))).alias("to"),
            F.sum(n * (excess(item_rest, p) - excess(item_rest, rest))).alias("back"),
        )
    )
    both = (
        counted.select("lang", "term", "source", "share", "rest")
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(corrections, "lang string, source string, item string, value long")
    )
    parts = [
        none,
        one.select("lang", "source", "item", F.col("to").alias("value")),
        one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")),
        both,
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    documents: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, shards: int | None = None
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` ranks a source's fellows by its divergence from them, part
    ``term`` its ``top`` terms by what they add to its divergence from the
    whole language. Ties go by item, in UTF-8 order.
    """
    texts = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = settle(frequencies(texts, least, shards))
    sizes = groups(texts, found)
    shares = found.join(sizes, ["lang", "source"]).withColumn(
        "share", share(F.col("count"), F.col("total"), F.col("terms"))
    )
    whole = share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    terms = (
        shares.withColumn("whole", whole)
        .filter("share > whole")
        .select("lang", "source", F.col("term").alias("item"), excess(F.col("share"), F.col("whole")).alias("value"))
    )
    order = [F.col("value").desc(), F.col("item")]
    of = ["lang", "source"]
    pairs = pair_values(shares, sizes)
    ranked = top_k_per_key(terms, of, order, top).withColumn("part", F.lit("term"))
    # The limit lets every rank through.
    ranked = ranked.unionByName(
        top_k_per_key(pairs, of, order, (1 << 31) - 1).withColumn("part", F.lit("pair"))
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")
