"""Temperature mixing: the exponent, the weights and what they are made of."""

import math
from collections import Counter, defaultdict

import pytest

from lendlens.llm import mixing, queries
from lendlens.llm.mixing import n_words
from tests.conftest import TESTDATA


def made_docs(spark, sizes, words=20):
    rows, key = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((key, source, " ".join(f"w{key}x{i}" for i in range(words))))
            key += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def totals_of(spark, shares):
    return spark.createDataFrame([(s,) for s in shares], "share double")


def entropy(shares, a):
    z = sum(s**a for s in shares)
    return -sum(s**a / z * math.log(s**a / z) for s in shares)


@pytest.mark.parametrize("target", [0.8, 0.95, 0.999])
def test_exponent_meets_entropy(spark, target):
    shares = [0.7, 0.15, 0.1, 0.05]
    a = mixing.exponent(totals_of(spark, shares), 4, target, 1e9)
    assert entropy(shares, a) == pytest.approx(target * math.log(4), abs=1e-6)
    assert 0 <= a <= 1


def test_exponent_meets_repetition(spark):
    shares = [0.7, 0.15, 0.1, 0.05]
    a = mixing.exponent(totals_of(spark, shares), 4, 1.0, 3.0)
    assert (0.05 / 0.7) ** (a - 1) == pytest.approx(3.0, abs=1e-6)


def test_exponent_of_even_and_single_sources(spark):
    assert mixing.exponent(totals_of(spark, [0.25] * 4), 4) == 1.0
    assert mixing.exponent(totals_of(spark, [1.0]), 1) == 1.0


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    sizes = {"big": 900, "mid": 200, "small": 50}
    docs = made_docs(spark, sizes)
    rows = mixing.uses(docs, entropy=0.99, repeats=4.0).collect()
    used = Counter(row["doc_id"] for row in rows)
    assert set(used) == {row["doc_id"] for row in docs.collect()}
    words, weight = Counter(), {}
    for row in rows:
        words[row["source"]] += row["n_words"]
        weight[row["source"]] = row["weight"]
    assert sum(weight.values()) == pytest.approx(1)
    for source in sizes:
        assert words[source] / sum(words.values()) == pytest.approx(weight[source], abs=0.003)
    # Whole passes and part of one: uses of a source's documents differ by one at most.
    passes = defaultdict(set)
    for row in rows:
        passes[row["source"]].add(used[row["doc_id"]])
        assert 0 <= row["place"] < 1 and row["pass"] < used[row["doc_id"]]
    assert all(max(p) - min(p) <= 1 for p in passes.values())
    assert max(used.values()) <= 4 and passes["big"] == {1}
    again = mixing.uses(docs, entropy=0.99, repeats=4.0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_smaller_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    docs = made_docs(spark, {"a": 300, "b": 100})
    rows = mixing.uses(docs, entropy=0.0, budget=4000.0).collect()
    assert 4000 <= sum(row["n_words"] for row in rows) <= 4000 + 2 * 20
    assert len({row["doc_id"] for row in rows}) == len(rows)


def test_query(spark, documents):
    _, texts = documents("sf0.01")
    rows = queries.op5_temperature_mixing(spark, f"{TESTDATA}/sf0.01").collect()
    assert {row["doc_id"] for row in rows} == set(texts)
    assert max(Counter(row["doc_id"] for row in rows).values()) <= mixing.REPEATS


def test_words(spark):
    texts = [("a\x0bb\x1cc \n",), ("",), (None,), (" ",)]
    rows = spark.createDataFrame(texts, "t string").select(n_words("t").alias("n")).collect()
    assert [row["n"] for row in rows] == [2, 0, 0, 0]


def test_edges(edge_docs, no_docs, spark):
    rows = mixing.mixed_rows(edge_docs)
    assert rows.columns == edge_docs.columns
    assert rows.distinct().count() == edge_docs.distinct().count()
    wordless = edge_docs.filter("text IS NULL")
    assert mixing.mixed_rows(wordless).count() == 1
    assert mixing.mixed_rows(no_docs).count() == 0
