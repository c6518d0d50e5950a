"""Inputs that the operators' tests share."""

from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for their own results.
CLASH = ["length", "score", "bucket", "block", "n", "part", "rank", "start", "items", "line", "hash", "class_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with null and clashing columns beside them."""

    def make(rows, partitions=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)
        return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASH])

    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Null and empty texts, blanks, a very long text, repeated rows, a null id, other scripts."""
    long = " ".join(f"word{k % 977} of the line" for k in range(40_000))
    same = "the same text stands here twice and is long enough to be of use to every operator of the list"
    return [
        (1, None),
        (2, ""),
        (3, " \n\t\x0b "),
        (4, long),
        (5, same),
        (5, same),
        (6, same),
        (None, same),
        (7, "Größe ÀÉÎ 日本語 текст ½ ☃ — naïve café"),
        (8, "ONE Two three <|endoftext|> four <|startoftext|>x"),
        (9, "!!! ... ??? 123 456"),
        (10, "a"),
        (11, "it's we'll J\u030c e\u0301 \u2003wide\u2003space\x1cfs"),
    ]

