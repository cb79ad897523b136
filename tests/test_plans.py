"""What the optimizer makes of the reports over stored tables."""

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import range_sums, tags
from lendlens.operators.range_sums import sums_after, sums_before
from lendlens.plans.reports import REPORTS, report, reports
from lendlens.sources.sample import sample
from lendlens.sources.schemas import Layout
from lendlens.sources.tables import Sources
from tests.conftest import AS_OF, TESTDATA


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The sample relations as tables, applications partitioned by both dates' months."""
    directory = str(tmp_path_factory.mktemp("tables"))
    made = sample(spark, f"{TESTDATA}/sf0.001")
    apps = made.loan_application.filter("date_created >= '1999-06-01'")
    monthly = apps.withColumns(
        {
            "created_month": F.trunc(F.to_date("date_created"), "MM"),
            "disbursed_month": F.trunc(F.to_date("disbursal_date"), "MM"),
        }
    ).drop("created_day")
    months = ["created_month", "disbursed_month"]
    monthly.repartition(2).write.partitionBy(*months).parquet(f"{directory}/loan_application")
    for name in ("loan_application_metadata", "app_user_history", "install_event"):
        getattr(made, name).drop("created_day").write.parquet(f"{directory}/{name}")
    return directory


MONTHLY = {
    "loan_application": [
        Layout("created_month", "date_created", "month"),
        Layout("disbursed_month", "disbursal_date", "month"),
    ]
}


def laid_out(spark, stored):
    return Sources.from_parquet(spark, stored, layouts=MONTHLY)


def partition_filters(text):
    return re.findall(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", text)[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return text.count("Exchange hashpartitioning")


def test_no_cross_join_and_no_python(spark, stored):
    sources = Sources.from_parquet(spark, stored)
    for name in REPORTS:
        text = plan(report(sources, name, AS_OF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


def test_creation_bound_prunes_and_reaches_the_scan(spark, stored):
    text = plan(report(laid_out(spark, stored), "rpt_changes_mom", AS_OF))
    assert re.search(r"created_month#\d+ >= 1999-10-01", partition_filters(text))
    assert "GreaterThanOrEqual(date_created,1999-10-17T13:30)" in text
    assert "user_id_ref" not in text.split("ReadSchema")[1]


def test_zoned_timestamps_are_bounded_in_their_own_type(spark, stored, tmp_path):
    zoned = spark.read.parquet(f"{stored}/loan_application")
    zoned = zoned.withColumn("date_created", F.col("date_created").cast("timestamp"))
    zoned.write.parquet(f"{tmp_path}/loan_application")
    df = report(Sources.from_parquet(spark, str(tmp_path)), "rpt_changes_mom", AS_OF)
    assert "GreaterThanOrEqual(date_created,1999-10-17 13:30:00.0)" in plan(df)
    naive = report(Sources.from_parquet(spark, stored), "rpt_changes_mom", AS_OF)
    assert df.collect() == naive.collect()


def test_volume_bound_reaches_the_scan(spark, stored):
    text = plan(report(Sources.from_parquet(spark, stored), "rpt_volume_projection", AS_OF))
    assert "GreaterThanOrEqual(disbursal_date,2000-02-01T00:00)" in text
    assert "In(loan_product_id, [1,5,6])" in text


def test_either_date_bound_reaches_the_scan(spark, stored):
    text = plan(report(Sources.from_parquet(spark, stored), "rpt_repeat_ats", AS_OF))
    assert re.search(
        r"Or\(GreaterThanOrEqual\(date_created,2000-01-15T00:00\),"
        r"GreaterThanOrEqual\(disbursal_date,2000-01-15T00:00\)\)",
        text,
    )


@pytest.mark.parametrize(
    "name, columns",
    [
        ("rpt_volume_projection", {"disbursed_month"}),
        ("rpt_repeat_ats", {"created_month", "disbursed_month"}),
        ("rpt_repeat_starts", {"created_month", "disbursed_month"}),
    ],
)
def test_disbursal_bound_prunes(spark, stored, name, columns):
    """Partitions go, rows of old applications paid lately stay."""
    pruned = report(laid_out(spark, stored), name, AS_OF)
    bounds = partition_filters(plan(pruned))
    assert set(re.findall(r"(\w+)#\d+ >=", bounds)) == columns
    assert pruned.collect() == report(Sources.from_parquet(spark, stored), name, AS_OF).collect()


@pytest.mark.parametrize("name", ["rpt_changes_mom", "rpt_channel_ats", "rpt_topup_ats"])
def test_layout_changes_no_report(spark, stored, name):
    whole = report(Sources.from_parquet(spark, stored), name, AS_OF).collect()
    assert report(laid_out(spark, stored), name, AS_OF).collect() == whole


@pytest.mark.parametrize(
    "name, expected",
    [
        # One shuffle for the groups; the tag join adds one per side and one for the
        # counts.
        ("rpt_changes_mom", 1),
        ("rpt_volume_projection", 1),
        ("rpt_partner_ats", 1),
        ("rpt_repeat_ats", 4),
        ("rpt_repeat_starts", 4),
    ],
)
def test_shuffles(spark, stored, name, expected):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(plan(report(Sources.from_parquet(spark, stored), name, AS_OF))) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_joins_read_their_inputs_once(spark, stored):
    """The plan names parts of it twice; they run once."""
    df = report(Sources.from_parquet(spark, stored), "rpt_channel_ats", AS_OF)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert shuffles(final) <= 18


def test_reports_together_share_scans(spark, stored):
    sources = Sources.from_parquet(spark, stored)
    alone = {name: report(sources, name, AS_OF).collect() for name in REPORTS}
    with reports(sources, REPORTS, AS_OF) as made:
        assert {name: df.collect() for name, df in made.items()} == alone
        funnels = [made[n] for n in ("rpt_changes_mom", "rpt_partner_ats", "rpt_topup_ats")]
        assert all("InMemoryTableScan" in plan(df) for df in funnels)
        repeat = [df for name, df in made.items() if name.startswith("rpt_repeat")]
        assert sum("InMemoryTableScan" in plan(df) for df in repeat) == 3
    assert "InMemoryTableScan" not in plan(report(sources, "rpt_changes_mom", AS_OF))


@pytest.fixture
def small_skew_limits(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_tag_join_splits_a_hot_application(spark, small_skew_limits):
    apps = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, 7, id) as id", "md5(cast(id as string)) as payload"
    )
    marked = spark.range(400_000).selectExpr(
        "id % 100000 as loan_application_id_ref",
        "if(id % 2 = 0, 'LOW_AND_GROW', 'STARTER_REPEAT') as tag_name",
        "timestamp_ntz'2000-03-01' as date_created",
    )
    counts = tags.tag_counts(marked, PeriodAnchors.of(AS_OF))
    joined = tags.left_two_tag_flags(apps, counts)
    by_copies = joined.groupBy("copies").agg(F.count("*").alias("n"), F.max("payload"))
    found = {row.copies: row.n for row in by_copies.collect()}
    assert sum(found.values()) == 200_000 and set(found) == {1, 4}
    assert "skew=true" in plan(by_copies).split("Initial Plan")[0]


def busy_hour(spark, size):
    """A third of the rows on one key, all within an hour, half of them at few instants."""
    tick = "if(id % 6 = 0, id % 50, id * 3600000000 div 100000)"
    return spark.range(size).selectExpr("if(id % 3 = 0, 7, id % 1000) as key", f"{tick} as tick")


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(range_sums, "SAMPLE", 50)
    monkeypatch.setattr(range_sums, "PER_SLICE", 8)


@pytest.mark.parametrize("sums, later", [(sums_before, False), (sums_after, True)])
def test_a_hot_key_is_spread_over_tasks(spark, small_slices, sums, later):
    """Slices hold nearly as many ticks each, although all lie within an hour."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        events, probes = (busy_hour(spark, n) for n in (60_000, 90_000))
        summed = sums(events.withColumn("n", F.lit(1)), probes, "key", ["n"])
        rows = summed.filter("key = 7").select("tick", "n", "copies", F.spark_partition_id())
        rows = rows.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    of_key = [sorted(r.tick for r in df.filter("key = 7").collect()) for df in (events, probes)]
    assert Counter({tick: copies for tick, _, copies, _ in rows}) == Counter(of_key[1])
    for tick, n, _, _ in rows:
        ahead = bisect_left(of_key[0], tick)
        assert n == (len(of_key[0]) - bisect_right(of_key[0], tick) if later else ahead)
    per_task = Counter(task for *_, task in rows)
    assert len(per_task) > 20 and max(per_task.values()) < len(rows) / 5


def test_channels_read_and_exchange_each_input_once(spark, stored):
    """Three scans, two for the cuts of each key; two exchanges for each key."""
    text = plan(report(Sources.from_parquet(spark, stored), "rpt_channel_starts", AS_OF))
    assert text.count("FileScan parquet") == 7
    assert len(re.findall(r"Window \[", text)) == 2
