from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "so") for b in ("n", "r", "st", "") for c in ("a", "ed", "ing", "o")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\nAnd"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text) with nulls, empty and long texts, ties, copies, near copies and repeated rows."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [(i, prose(i, 30 + 7 * i)) for i in range(2, 14)]
    rows += [(20, base), (21, base), (22, near), (23, near.upper()), (24, None), (25, ""), (26, " \n\t "), (27, "one"), (None, "no id here"), (None, None)]
    rows += [(30, prose(30, 6000)), (31, prose(31, 40) + " " + base + " " + prose(32, 40)), (32, "a" * 9000), (20, base), (40, prose(5, 65))]
    rows += [(50 + i, "a\0b <|endoftext|>") for i in range(2)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents beside columns whose names operators may use inside."""
    rows = [(d, t, ("a", "b", None)[i % 3], i, 0.5, "x") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, score double, key string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
