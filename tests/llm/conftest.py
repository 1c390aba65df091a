import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and blank texts, ties, repeated rows, a long text and a text of one endless word."""
    words = [f"w{i % 997}" for i in range(60_000)]
    return frame(
        [
            (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (5, "one two three four five six"),
            (6, "One TWO three four five six"), (None, "one two three four five six"), (None, None), (7, " ".join(words)),
            (8, "x" * 300_000), (9, "naïve café 漢字 🙂 ½ İstanbul x　y"), (10, "a\nb\n\na\nb\n" * 30), (11, "one two three four five six", None),
        ]
    )
