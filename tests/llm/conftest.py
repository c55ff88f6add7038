from __future__ import annotations

import random

import pytest

from vitrine.session import ensure_checkpoint_dir

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    return ensure_checkpoint_dir(spark)


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Awkward texts: null, empty, blank, ties, copies, near copies, shared passages, long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "STRASSE", "naïve", "x" * 30]

    def prose(k: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\n", ", "]) for _ in range(k))

    passage = prose(70)
    out: list[str | None] = [None, "", " \n\t ", "one", "one", "a\nb\na\n\na", "Z " * 400, "q" * 700, "q" * 700]
    while len(out) < n:
        kind = rng.randrange(5)
        base = prose(rng.randrange(1, 120))
        if kind == 0:
            base = rng.choice([t for t in out if t]) + rng.choice(["", "", " tail"])
        if kind == 1:
            base = base + passage + prose(5)
        if kind == 2:
            words = (rng.choice([t for t in out if t]) or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            base = " ".join(words)
        out.append(base)
    return out


@pytest.fixture(scope="session")
def sample() -> list[tuple[int, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source) with a hot source, null columns and repeated rows."""
    rng = random.Random(5)
    rows = []
    for i, text in enumerate(texts()):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((i, text, rng.choice(["en", "fr", None]), source))
    rows.append(rows[-1])
    rows.append((5, rows[-2][1], "en", "b"))
    return rows


@pytest.fixture(scope="session")
def documents(spark, sample):
    """The sample with columns whose names clash with those used inside."""
    rows = [(i, t, lang, s, None if t is None else len(t), "r", "k") for i, t, lang, s in sample]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def tuples(df, *columns):
    key = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
