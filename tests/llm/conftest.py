"""Rows with every awkward case: nulls, empty and long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, copies int, piece int, rank int, fp long, word string, n long, y int, cls int, kept boolean, host string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("th", "an", "in", "er", "on", "re", "at")) + rng.choice(("tion", "ing", "ed", "ly", "ha", "st")) for _ in range(n))


def rows() -> list[tuple]:
    texts = [words(i, 30 + 7 * i) for i in range(30)]
    base = [
        *[(i, t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts)],
        (30, texts[3], "en", "s0"), (31, texts[3], "en", None), (31, texts[3], "en", None), (32, None, None, None), (33, "", "en", "s1"), (34, " \n\t ", "de", "s1"), (None, "no id here at all", "en", "s2"), (None, None, None, None),
        (35, "x" * 5000, "en", "s2"), (36, words(99, 9000), "en", "s3"), (37, "Über Ωmega 日本語 naïve é ᾼ <|endoftext|> it's 12,5", "de", "s3"), (38, "one", "en", "s3"), (39, texts[5].upper(), "en", "é"), (40, "###  $$$ %%%", "en", "é"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 3, 9, 8, 7, 6, "w", 4, 1, 2, True, "h") for r in base]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in rows()]
