"""The pipeline against each stage's brute-force rules, every stage on its own input."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from vitrine.llm.cube import mix, word_count
from vitrine.llm.quality import line_quality

from . import test_golay, test_winnowing
from .test_quality import base


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory, data):
    """What each stage returns, written as Parquet and read again."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert set(steps[0].columns) < set(steps[-1].columns)


def test_quality(steps):
    kept = {r[0] for r in rows(steps[1])}
    assert kept == {r.id for r in line_quality(steps[0]).filter("kept").collect()}
    assert not any(base(t)[-1] for i, t, *_ in rows(steps[0]) if i in kept)


def test_lines(steps):
    before = {r[0]: r[1].split("\n") for r in rows(steps[1])}
    after = {r.doc_id: r for r in steps[2].collect()}
    assert before.keys() == after.keys()
    seen = set()
    for i in sorted(before):
        left = iter(before[i])
        assert after[i].text == "" or all(x in left for x in after[i].text.split("\n"))
        assert after[i].n_chars == len(after[i].text)
        for line in after[i].text.split("\n"):
            form = " ".join(test_winnowing.words(line))
            if form.count(" ") >= 4:
                assert form not in seen
                seen.add(form)


def test_near_duplicates(steps):
    wanted = {c for _i, _m, c in test_golay.brute(rows(steps[2]))}
    assert {r[0] for r in rows(steps[3])} == wanted and steps[3].count() == len(wanted)


def test_contamination(spark, data, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_winnowing.brute(rows(steps[3]), items) if r[2] == 0}
    assert {r[0] for r in rows(steps[4])} == clean


def test_mix(steps):
    chosen = {r.id: r.copies for r in mix(steps[4], word_count("text")).collect()}
    assert {r.doc_id: r.copies for r in steps[5].collect()} == {i: n for i, n in chosen.items() if n}


def test_run_is_the_stages(spark, data, steps):
    found = corpus_pipeline.run(spark, data)
    assert sorted(map(str, found.collect())) == sorted(map(str, steps[-1].collect()))


def test_empty_and_awkward(spark, data, documents, no_documents):
    for docs in (documents, no_documents):
        for _name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() >= 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
