from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA

#: Names that the operators use inside; a table may have them too.
CLASHING = (
    "of_lang of_source fit_key inverse mean _row _stats _kept bucket block h pass digest n "
    "text_key text_hash shingles content piece spans slot shard uses place draw made again"
).split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    long_text = sentence(rng, 40_000)
    usual = [sentence(rng, 80) for _ in range(8)]
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, long_text, "en", None),
        (5, long_text, "en", "b"),
        (None, usual[0], None, None),
        (None, usual[0], None, None),
        (6, "one two", "de", "b"),
        (7, "one two", "de", "b"),
        (8, "é中\U0001f600 | ### $$$", "de", "b"),
        (9, usual[1], "en", "a"),
        (9, usual[1], "en", "a"),
        *((10 + i, text, "en", "a") for i, text in enumerate(usual)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    """The sample documents of a scale, with their texts by doc_id."""
    def read(scale):
        docs = spark.read.parquet(f"{TESTDATA}/{scale}/documents.parquet")
        return docs, {row["doc_id"]: row["text"] for row in docs.select("doc_id", "text").collect()}

    return read
