from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _drops string, size string, quality int"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    line = "one two three four five six seven eight nine ten"
    texts = [
        (1, None, "a"), (2, "", "a"), (3, long, None), (3, long, None), (4, line, "b"), (5, f"{line}\n{line}\nshort", "b"),
        (6, line.replace("five", "5ive"), "b"), (7, line.replace("five ", ""), "a"), (7, "other text of the same id", "a"),
        (None, line, None), (None, None, None), (8, " \n\t", "a"), (9, "x", "é"), (10, "x", "z"), (11, "İ ß \x1c ÀB", "z"),
        (12, " ".join(["again"] * 400), "a"), (13, "😀 " * 50 + line, "b"), (14, "y" * 200_000, "b"),
        (15, " ".join(f"clean{i}" for i in range(40)), "a"),
    ]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", "c", 1) for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id > 1000")
