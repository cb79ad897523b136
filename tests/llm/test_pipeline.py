"""The stages of the corpus pipeline, each against its own input."""

import pytest

import corpus_pipeline
from lendlens.llm import decontamination, near_dedup, outliers
from lendlens.llm.scratch import written
from tests.conftest import TESTDATA
from tests.llm.test_near_dedup import brute_components

SF = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    made = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], SF), name))
    return made


def ids(df):
    return sorted(row["doc_id"] for row in df.select("doc_id").collect())


def test_columns(tables):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(table.columns == tables[0].columns for table in tables[:-1])


def test_quality(tables):
    verdicts = outliers.verdicts(tables[0])
    assert ids(tables[1]) == ids(verdicts.filter("kept"))


def test_one_of_each_group(tables):
    texts = {row["doc_id"]: row["text"] for row in tables[1].collect()}
    expected = brute_components(texts)
    assert ids(tables[2]) == sorted(set(expected.values()))
    assert near_dedup.deduplicated(tables[2]).filter("NOT kept").count() == 0


def test_no_leak_is_left(spark, tables):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = set(ids(decontamination.leaks(tables[2], items)))
    assert ids(tables[3]) == sorted(set(ids(tables[2])) - leaked)
    assert decontamination.leaks(tables[3], items).count() == 0


def test_mixture_and_shards(tables):
    assert set(ids(tables[4])) == set(ids(tables[3]))
    assert ids(tables[5]) == ids(tables[4])


def test_run(spark, tables):
    made = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "size", "text_crc32"]
    assert made.select(columns).exceptAll(tables[-1].select(columns)).count() == 0
    assert made.count() == tables[-1].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "empty")
    assert docs.count() == 0
