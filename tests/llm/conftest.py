from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, sha string, n bigint, host string, fold int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) for _ in range(words))


def corpus() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, copies, near copies, repeated rows and one long text."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, "  " + base.upper() + "\n", None, "", " \t\n", "one", "one two three", prose(2, 300), prose(3, 9000), base + " tail", "ünï ⊕ 漢字 🙂 text", "a\x00b\x1fc"]
    texts += [prose(k, 40 + k) for k in range(10, 22)]
    rows = [(k, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None, "clash", "clash", 1, "clash", 2) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
