from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, id string, size long, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); further columns clash with names that operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "r", "i", 7, "k") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented prose: prose(seed, words)."""

    def make(seed: int, n: int, letters: str = "abcdefghijklmnop") -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls, empty and blank texts, one word, equal rows, a long text, odd characters."""
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (4, "word", "en", "b"),
        (5, "Word", "de", None),
        (6, prose(1, 400), "en", "b"),
        (6, prose(1, 400), "en", "b"),
        (7, prose(2, 30000), "de", "a"),
        (8, "ÄÖ é 漢字 🙂 \x00 x\u00a0y 1 2 3 --", "fr", "c"),
    ]
