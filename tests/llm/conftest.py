"""Odd rows that every operator must bear: nulls, empty and long texts, ties, repeats, and columns whose names clash."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, size long, chunk string, shard string, fp string, slot int, row_key string, spans string, _id string, _row int, _quality int, _keep int, epoch int, rank int, kind string"
LONG = " ".join(f"word{i % 977} token{i % 31}" for i in range(30_000))


def odd_rows():
    rows = [
        (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "One two three four five six seven eight nine ten eleven"),
        (6, "One two three four five six seven eight nine ten eleven"), (7, LONG), (8, LONG + " tail"), (9, "été Straße Ω 漢字 🙂 naïve"), (10, "\x00\x01 control"),
        (10, "repeated id"), (10, "repeated id"), (None, "no id"), (None, None), (11, "a a a a a a a a a a a a"),
    ]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, k, 0.5, 7, "c", "s", "f", 1, "r", "x", "i", 3, 1, 2, 9, 1, "k") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 12)] + [(None, 1, None, "x"), (4, None, None, None)], "doc_id long, quality int, toxic int, text string")
