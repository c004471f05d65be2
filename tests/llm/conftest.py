from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, size string, score string, n_tokens string, "
    "shard string, kept string, n_shingles string, log_weight string, lang_pred string"
)
CLASH = ("a", "b", "c", "d", "e", "f", "g", "h")


@pytest.fixture(scope="session")
def sf_dir():
    import os

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(3, 9))) for _ in range(600)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    """``prose(seed, n)``: n words in sentences and lines, the same for the same seed."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        out = []
        for i in range(n):
            out.append(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 and i < n - 1 else " "))
        return "".join(out).strip()

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null ids and texts, empty and blank texts, one very long text, ties, repeated rows, clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, None), (4, long, "en", None),
        (5, prose(2, 80), "en", "b"), (6, prose(2, 80), "en", "b"), (5, prose(2, 80), "en", "b"), (5, prose(3, 70), "fr", "b"),
        (None, prose(2, 80), None, "c"), (None, None, None, None), (7, "one two", "fr", "c"), (8, "one two", "fr", "é"),
        (9, "漢字 😀 #### x\n\nx\nx", "fr", "c"), (10, "w" * 5_000, "en", "c"), (11, prose(2, 79) + " changed", "en", "c"),
    ]
    return [(*r, *CLASH) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
