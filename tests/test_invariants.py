"""Relations between operators that hold on any input."""

import pytest
from pyspark.sql import functions as F

from lendlens.functions import classify
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import aggregates, filters, tags
from lendlens.operators.results import union_all
from lendlens.sources.sample import sample
from tests.conftest import AS_OF, TESTDATA

ANCHORS = PeriodAnchors


@pytest.fixture(scope="module")
def sources(spark):
    return sample(spark, f"{TESTDATA}/sf0.01")


@pytest.mark.parametrize("grain", ["ts", "date"])
@pytest.mark.parametrize("with_product", [True, False])
def test_two_levels_equal_one(sources, grain, with_product):
    anchors = ANCHORS.of(AS_OF)
    df = filters.lookback_150d(sources.loan_application, anchors).withColumns(
        {"programme": classify.programme_two_app(), "ticket_size": classify.ticket_size()}
    )
    keys = ["programme", "ticket_size"]
    one = aggregates.period_pivot(df, keys, anchors, grain).collect()
    two = aggregates.two_level(df, keys, anchors, grain, with_product).collect()
    assert len(one) > 10
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_branch_counts_equal_the_union(sources):
    anchors = ANCHORS.of(AS_OF)
    apps = sources.loan_application
    union = union_all(filters.lookback_60d(apps, anchors), filters.disbursed_60d(apps, anchors))
    branches = tags.recent_branches(apps, anchors)
    expected = {r.id: r["count"] for r in union.groupBy("id").count().collect()}
    assert {r.id: r.branches for r in branches.collect()} == expected
    either = filters.either_date_60d(apps, anchors).count()
    both = branches.filter("branches = 2").count()
    assert union.count() == either + both and both > 0


def test_copies_equal_joined_rows(sources):
    anchors = ANCHORS.of(AS_OF)
    apps = sources.loan_application
    recent = filters.lookback_60d(sources.loan_application_metadata, anchors)
    labelled = recent.select(
        "loan_application_id_ref", classify.tag_bucket().alias("bucket")
    ).filter("bucket is not null")
    low = labelled.filter("bucket = 'LowNGrow'").select(F.col("loan_application_id_ref").alias("l"))
    starter = labelled.filter("bucket = 'Starter'").select(
        F.col("loan_application_id_ref").alias("r")
    )
    joined = apps.join(low, apps.id == low.l, "left").join(starter, apps.id == starter.r, "left")
    expected = {r.id: r["count"] for r in joined.groupBy("id").count().collect()}
    got = tags.left_two_tag_flags(apps, tags.tag_counts(sources.loan_application_metadata, anchors))
    assert {r.id: r.copies for r in got.collect()} == expected
    assert max(expected.values()) > 4


def test_measures_stay_within_the_rows(sources):
    anchors = ANCHORS.of(AS_OF)
    df = filters.lookback_150d(sources.loan_application, anchors).withColumn(
        "programme", classify.programme_single_app()
    )
    rows = {r.programme: r["count"] for r in df.groupBy("programme").count().collect()}
    for row in aggregates.period_pivot(df, ["programme"], anchors).collect():
        assert row.last_starts + row.current_starts <= rows[row.programme]
        assert row.last_disbursed + row.current_disbursed <= rows[row.programme]
