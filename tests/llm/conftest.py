from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; a caller's columns of these names must do no harm.
CLASHING = "_row bigint, _doc string, _key string, n string, h bigint, kept string, shard int, size int, cid int, a int, ranges int"


def sentence(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "and", "on", "ti", "re", "sha", "wen", "dor", "lis", "mo", "ka"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared lines, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    texts: list[str | None] = [sentence(rng, rng.randint(1, 250)) for _ in range(n)]
    for k in range(0, n, 6):
        words = texts[k].split(" ")
        texts.append(" ".join(words))
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{texts[k]}\n{shared}\n{sentence(rng, 30)}" for k in range(1, n, 5)]
    texts += [None, "", " \t\n", "é" * 300, "ab" * 400, sentence(rng, 20_000), "Ärger im Büro #1 $$$", "one two three"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, "no id here", "en", "s1", 10)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def clashing(spark, rows):
    wide = [(*r, 7, "x", "y", "z", 5, "w", 1, 2, 3, 4, 6) for r in rows]
    return spark.createDataFrame(wide, f"{SCHEMA}, {CLASHING}").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
