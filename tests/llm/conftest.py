from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns whose names operators might use themselves."""
    rows = [
        (1, "One line here.\nShared line\nThird", "en", "a"),
        (2, "", "en", "a"),
        (3, None, None, None),
        (None, "no id at all\nShared line", "de", "b"),
        (5, LONG, "en", "b"),
        (6, "twice the same row", "fr", None),
        (6, "twice the same row", "fr", None),
        (6, "same id, other text", "fr", "c"),
        (8, " \n\t\n", "en", "c"),
        (9, "ünïcödé – tëxt, 日本語\nSHARED LINE ", "es", "c"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 1, "y", [1]) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, lines string, bands array<int>")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
