"""Joins of stored buckets: the same rows, and no exchange before the final aggregate."""

import uuid

import pytest
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import by_application, tags
from lendlens.plans.reports import report
from lendlens.sources.sample import sample
from lendlens.sources.tables import Sources
from tests.conftest import AS_OF, TESTDATA

BUCKETS = 6


@pytest.fixture
def broadcasts_off(spark):
    settings = (
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
    )
    for key in settings:
        spark.conf.set(key, "-1")
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The sample as it is, and stored, the tags of odd days appended."""
    folder, name = tmp_path_factory.mktemp("stored"), f"t{uuid.uuid4().hex}"
    made = sample(spark, f"{TESTDATA}/sf0.01")
    apps, marks = made.loan_application.drop("created_day"), made.loan_application_metadata
    by_application.store_applications(apps, f"{name}_apps", BUCKETS, f"{folder}/apps")
    odd = F.dayofmonth("date_created") % 2 == 1
    for part, mode in ((marks.filter(~odd), "errorifexists"), (marks.filter(odd), "append")):
        by_application.store_tags(part, f"{name}_tags", BUCKETS, f"{folder}/tags", mode)
    relations = {"loan_application": f"{name}_apps"}
    stored = Sources.from_catalog(spark, relations).with_tag_days(spark.table(f"{name}_tags"))
    yield made, stored
    for table in ("apps", "tags"):
        spark.sql(f"DROP TABLE {name}_{table}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "join", [tags.left_tag_flag, tags.left_two_tag_flags, tags.left_tag_bucket]
)
def test_join_without_exchange(both, broadcasts_off, join):
    plain, stored = both
    anchors = PeriodAnchors.of(AS_OF)
    rows = []
    for sources in (plain, stored):
        joined = join(sources.loan_application, by_application.counts_of(sources, anchors))
        joined = joined.drop("created_day")
        if sources is stored:
            assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        rows.append(sorted(map(str, joined.collect())))
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["rpt_repeat_ats", "rpt_repeat_starts"])
def test_reports(both, broadcasts_off, name):
    """One exchange, of the groups, and the sort of the few rows shown."""
    plain, stored = both
    made = report(stored, name, AS_OF)
    assert plan(made).count("Exchange hashpartitioning") == 1
    assert made.collect() == report(plain, name, AS_OF).collect()


def test_edges(spark, both, tmp_path):
    none = spark.createDataFrame([], both[0].loan_application_metadata.schema)
    assert by_application.tag_days(none).count() == 0
    blank = spark.sql(
        "select cast(null as bigint) as loan_application_id_ref, 'STARTER_REPEAT' as tag_name,"
        " timestamp_ntz'2000-03-01' as date_created union all select 1, null, null"
        " union all select 1, 'STARTER_REPEAT', null"
    )
    assert by_application.tag_days(blank).count() == 0
    hot = spark.range(by_application.MOST_ROWS + 1).selectExpr("7L as id")
    with pytest.raises(by_application.HotApplication):
        by_application.store_applications(hot, "never_made", 2, str(tmp_path))
