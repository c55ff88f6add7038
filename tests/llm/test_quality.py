from __future__ import annotations

import re

from vitrine.llm.quality import keep_good, line_quality

from .conftest import tuples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_base_against_brute_force(documents, sample):
    found = tuples(line_quality(documents), "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted((i, *base(t)) for i, t, *_ in sample)
    assert {r[-1] for r in found} == {True, False}


def prose(i, n=30):
    return " ".join(f"d{i}x{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(n))


def test_boilerplate_and_depleted(spark):
    footer = "All rights  reserved 2024 by the " + " ".join(f"p{chr(97 + i)}" for i in range(20))
    rows = [(i, f"{prose(i)}\n{footer}", "h") for i in range(15)]
    rows += [(100, f"few own words\n{footer.upper()}", "h"), (101, f"few own words there\n{footer}", "other")]
    rows += [(200 + i, prose(90) + "\n" + prose(91), "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r.id: r for r in line_quality(docs).collect()}
    assert all(found[i].kept and found[i].n_boilerplate_lines == 1 for i in range(15))
    assert not found[100].kept and not found[100].base_failed
    assert found[101].kept and found[101].n_boilerplate_lines == 0
    # Copies of one document are not independent evidence against its lines.
    assert all(found[200 + i].kept and found[200 + i].n_boilerplate_lines == 0 for i in range(40))
    assert sorted(r.doc_id for r in keep_good(docs).collect()) == sorted(i for i, r in found.items() if r.kept)


def test_keep_good_keeps_columns(documents, sample):
    kept = keep_good(documents)
    assert kept.columns == documents.columns
    verdict = {r.id: r.kept for r in line_quality(documents).collect()}
    assert {r.doc_id for r in kept.collect()} <= {i for i, ok in verdict.items() if ok} | {5}


def test_empty(no_documents):
    assert line_quality(no_documents).collect() == []
    assert keep_good(no_documents).collect() == []


def templates(own, shared):
    """60 unrelated documents of ``shared`` template lines around ``own`` lines of their own."""
    template = [prose(500 + k, 8) for k in range(shared)]
    return ["\n".join([*template, *(prose(i * own + k, 6) for k in range(own))]) for i in range(60)]


def test_templates_of_several_lines(spark):
    for own, shared in ((1, 3), (1, 2), (2, 5), (4, 8)):
        docs = spark.createDataFrame(
            [(i, t, "h") for i, t in enumerate(templates(own, shared))], "doc_id long, text string, source string"
        )
        found = line_quality(docs).collect()
        assert {r.n_boilerplate_lines for r in found} == {shared}
        assert {r.kept for r in found} == {own == 4 or own * 6 >= 20}


def test_copies_do_not_hide_a_template(spark):
    footer = prose(600, 12)
    rows = [(i, f"{prose(i)}\n{footer}", "h") for i in range(100)]
    rows += [(1000 + i, f"{prose(300)}\n{footer}", "h") for i in range(400)]
    # Near copies: one changed word in a long text.
    near = [prose(310 + k) for k in range(20)]
    rows += [(2000 + i, "\n".join([*near, f"changed {prose(320)} number{chr(97 + i)}"]), "h") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r.id: r for r in line_quality(docs).collect()}
    assert all(r.n_boilerplate_lines == (0 if i >= 2000 else 1) and r.kept for i, r in found.items())


def test_boilerplate_is_taken_out(spark):
    from corpus_pipeline import quality_rules

    footer = prose(700, 12)
    rows = [(i, f"{footer}\n\n{prose(i)}\n{footer.upper()}", "h") for i in range(12)]
    rows += [(100, f"{footer}\n{prose(100)}", "other"), (101, None, "h")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_chars long")
    found = {r.doc_id: r for r in quality_rules(spark, docs.repartition(3), "").collect()}
    assert found.keys() == {*range(12), 100}
    assert all(found[i].text == f"\n{prose(i)}" and found[i].n_chars == len(found[i].text) for i in range(12))
    assert found[100].text == rows[12][1] and found[100].n_chars == 1
    assert {r.id: r.gone for r in line_quality(docs).collect()}[3] == [0, 3]
