from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from vitrine.llm import divergence as module
from vitrine.llm.divergence import Block, divergence, frequencies, merged

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=3, top=200):
    """Shares of every kept term in every group, compared one by one."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(AZ))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {lang for lang, _s in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for lang_, s in groups if lang_ == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [
                (-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]
            ]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return sorted(out)


def found(df):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "ÉTÉ", "STRASSE", "日本語", "𝒳𝓎"]
    texts = [None, "", " \n ", "12 34", "one", "q" * 900]

    def prose():
        cut = rng.choice([8, 30, len(vocabulary)])
        return "".join(rng.choice(vocabulary[:cut]) + rng.choice([" ", "-", "7", "\x00", "\n"]) for _ in range(rng.randrange(1, 70)))

    texts += [prose() for _ in range(150)]
    return [
        (t, rng.choice(["en", "en", "fr", None, ""]), "hot" if i % 3 == 0 else rng.choice(["a", "b", "ü", None, ""]))
        for i, t in enumerate(texts * 2)
    ] + [("lonely", "xx", "z"), (None, "yy", "a"), ("", "yy", None)]


def frame(spark, rows):
    data = [(i, *r, 1, "t") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, rank int, term string").repartition(4)


def test_against_brute_force(spark, rows):
    assert found(divergence(frame(spark, rows))) == brute(rows)


def test_few_top_terms_and_shards(spark, rows):
    assert found(divergence(frame(spark, rows), least=1, top=3, shards=1)) == brute(rows, 1, 3)


def test_small_blocks_chunks_and_pair_sums(spark, rows, monkeypatch):
    """Many spilled runs, chunks that overlap, and sums handed out early give the same values."""
    df = frame(spark, rows)
    for name, value in {
        "BLOCK_BYTES": 2000, "CHUNK_POSTINGS": 3, "CHUNKS_OUT": 2, "SCAN_BYTES": 5, "PAIRS_AT_ONCE": 2, "PAIRS_HELD": 4,
    }.items():
        monkeypatch.setattr(module, name, value)
    block, runs = Block(), []
    for text, lang, source in rows:
        block.add(lang or "", source or "", (text or "").encode())
        if block.held > module.BLOCK_BYTES:
            runs += [(b, i) for b in block.runs(1) for i in range(b.num_rows)]
    runs += [(b, i) for b in block.runs(1) for i in range(b.num_rows)]
    assert len(runs) > 100
    runs.sort(key=lambda r: (r[0].column(1)[r[1]].as_py(), r[0].column(2)[r[1]].as_py()))
    counts = Counter()
    for step, least in ((1, 1), (3, 1), (10_000, 3)):
        monkeypatch.setattr(module, "STRETCH_POSTINGS", step)
        counts = Counter()
        for b in merged((b.slice(i, 1) for b, i in runs), least):
            for r in b.to_pylist():
                counts[r["lang"], r["source"], r["term"]] += r["count"]
        seen, wanted = defaultdict(Counter), Counter()
        for text, lang, source in rows:
            terms = TERM.findall((text or "").translate(AZ))
            seen[lang or ""].update(set(terms))
            wanted.update((lang or "", source or "", t) for t in terms)
        assert counts == {k: n for k, n in wanted.items() if seen[k[0]][k[2]] >= least}
    assert found(divergence(df)) == brute(rows)


def test_corrections_a_few_pairs_at_a_time(spark, rows, monkeypatch):
    shares = [("en", f"t{t:03}", f"s{s}", 10 + (s * t) % 7, 1 + s) for t in range(40) for s in range(1 + t % 9)]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*shares), kinds)], names=["lang", "term", "source", "share", "rest"])

    def sums(step):
        out = Counter()
        for b in module.corrections(iter(table.to_batches(max_chunksize=step))):
            for r in b.to_pylist():
                out[r["source"], r["item"]] += r["value"]
        return out

    whole = sums(1000)
    monkeypatch.setattr(module, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(module, "PAIRS_HELD", 7)
    assert sums(3) == whole and len(whole) == 72


def test_long_texts_and_hot_groups(spark):
    long = "alpha beta gamma " * 330_000
    rows = [(long, "en", "hot"), ("x" * 2_500_000, "en", "hot")] + [("alpha delta", "en", "hot")] * 900 + [("beta", "en", "cold")] * 4
    assert found(divergence(frame(spark, rows))) == brute(rows)


def test_many_sources(spark):
    rows = [(f"common t{chr(97 + i % 20)}", "en", f"s{i % 300:03}") for i in range(1200)]
    assert found(divergence(frame(spark, rows))) == brute(rows)


def test_empty_table(spark, no_documents):
    assert found(divergence(no_documents)) == []
    assert frequencies(no_documents.select("lang", "source", "text")).collect() == []
