"""Batches that go to Python functions are bounded by their bytes, whatever a row holds."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendlens.llm import batches, near_dedup, outliers


def measured(found):
    for batch in found:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])


def texts(session):
    """Texts of 20 kB each in one partition."""
    word = F.concat(F.lit("w"), (F.col("id") % 7).cast("string"), F.lit("x" * 18))
    text = F.concat(F.repeat(F.concat(word, F.lit(" ")), 950), F.col("id").cast("string"))
    rows = session.range(0, 400, 1, 1)
    return rows.select(
        F.col("id").alias("doc_id"),
        text.alias("text"),
        F.lit("en").alias("lang"),
        F.lit("web").alias("source"),
    )


@pytest.mark.parametrize("stage", [outliers.kept_rows, near_dedup.kept_rows])
def test_long_texts_travel_in_small_batches(spark, stage):
    docs = texts(spark.newSession())
    stage(docs).count()
    sizes = [row["size"] for row in docs.mapInArrow(measured, "size long").collect()]
    assert sum(sizes) > 6 * batches.BYTES
    assert max(sizes) < 2 * batches.BYTES


def test_a_setting_that_is_there_stays(spark):
    session = spark.newSession()
    session.conf.set(batches.KEY, "5000000")
    batches.bounded(texts(session))
    assert session.conf.get(batches.KEY) == "5000000"
