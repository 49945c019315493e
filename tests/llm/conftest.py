"""Documents with every odd case."""

from __future__ import annotations

import pytest

ODD = [
    (0, None),
    (1, ""),
    (2, "   \n\t "),
    (3, "a"),
    (4, "the cat sat on the mat"),
    (5, "the cat sat on the mat"),
    (6, "  leading and  double spaces "),
    (7, "line one\nline two\n\nline four"),
    (8, "ÀÉÎ õü ß 日本語 😀 ﬁ"),
    (9, "<s> <|endoftext|> <0x41> ▁mark▁"),
    (10, "word " * 3000),
    (11, "x" * 5000),
    (12, None),
    (13, "THE cat Sat on the MAT"),
    (14, "\x00\x01 control \x1f"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, one row twice, with extra columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "src", "keep", 1, 0.5, "x") for i, t in [*ODD, ODD[4]]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, text_sha256 string, maybe int, score double, k string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def without_ids(spark):
    """Some rows have no id."""
    rows = [(None, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "all alone here"), (None, None), (2, "another text of some words")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")
