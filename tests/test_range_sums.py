"""Sums against pairs formed by brute force, with large keys, split or not, and ties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import attribution
from lendlens.operators import range_sums
from lendlens.operators.range_sums import sums_after, sums_before
from lendlens.plans.reports import REPORTS, report
from tests.conftest import AS_OF, Made

MEASURES = ["n", "amount"]
EVERY_TICK, NO_KEY = 1, 10**9
MINUTE = 60_000_000


def rows(seed, size):
    """A third of the rows on one key, a third of those on one tick; some keys missing."""
    draw = random.Random(seed)
    out = []
    for i in range(size):
        key = None if i % 20 == 0 else "hot" if i % 3 == 0 else f"k{draw.randrange(8)}"
        tick = 5 * MINUTE if i % 9 == 0 else draw.randrange(-3 * MINUTE, 12 * MINUTE, MINUTE // 4)
        out.append((key, None if i % 31 == 0 else tick, i))
    return out


@pytest.fixture(params=[EVERY_TICK, 5, NO_KEY])
def split(request, monkeypatch):
    """How keys are cut: before every tick but the first, after a few of them, not at all."""
    monkeypatch.setattr(range_sums, "SAMPLE", 1)
    monkeypatch.setattr(range_sums, "PER_SLICE", request.param)


@pytest.mark.parametrize("sums, later", [(sums_before, False), (sums_after, True)])
def test_against_pairs(spark, split, sums, later):
    events, probes = rows(1, 300), rows(2, 300)
    got = sums(
        spark.createDataFrame(events, "key string, tick bigint, i bigint").selectExpr(
            "key", "tick", "i as n", "cast(i as decimal(18,2)) / 4 as amount"
        ),
        spark.createDataFrame(probes, "key string, tick bigint, probe bigint"),
        "key",
        MEASURES,
    ).collect()
    expected = []
    for key, tick, probe in probes:
        if key is None or tick is None:
            continue
        total = sum(
            i
            for k, t, i in events
            if k == key and t is not None and (t > tick if later else t < tick)
        )
        expected.append((key, tick, probe, total, total / 4))
    assert sorted((r.key, r.tick, r.probe, r.n, float(r.amount)) for r in got) == sorted(expected)


def busy(spark):
    """One user and one attribution id with most of the rows."""
    draw = random.Random(3)
    made = Made(spark)

    def when():
        month, day = draw.choice([(2, 3), (2, 14), (2, 15), (3, 1), (3, 14)])
        return f"2000-{month:02}-{day:02} {draw.randrange(24):02}:{draw.choice([0, 30]):02}:00"

    for _ in range(60):
        user = draw.choice([1, 1, 1, 2, 3, None])
        made.app(when(), draw.choice([None, when()]), user=user, amount=draw.choice([None, "5.25"]))
    for _ in range(60):
        made.visit(draw.choice([1, 1, 2, 3, None]), draw.choice(["a", "a", "b", None]), when())
    for _ in range(40):
        made.install(draw.choice(["a", "a", "b", None]), draw.choice(["X", "y", None]), when())
    return made


PAIRS = """
    select lower(coalesce(i.campaign_type, 'organic')) as campaign_type, a.*
    from a join h on a.user_id_ref = h.user_id_ref
      and a.date_created > h.date_created - interval 1 hour
    join i on h.attribution_id = i.attribution_id
      and h.date_created > i.date_created - interval 1 hour"""


def test_channel_measures_against_pairs(spark, split):
    made = busy(spark)
    frames = made.frames()
    apps, history, installs = (
        frames[n] for n in ("loan_application", "app_user_history", "install_event")
    )
    got = attribution.channel_measures(
        apps, history, installs, PeriodAnchors.of(AS_OF)
    ).collect()
    pairs = _pairs(spark, frames)
    last = "between date'2000-02-01' and date'2000-02-15'"
    current = "between date'2000-03-01' and date'2000-03-15'"
    made_on, paid_on = "cast(date_created as date)", "cast(disbursal_date as date)"
    expected = (
        pairs.groupBy("campaign_type")
        .agg(
            F.expr(f"count_if({made_on} {last})"),
            F.expr(f"count_if({made_on} {current})"),
            F.expr(f"count_if({paid_on} {last})"),
            F.expr(f"count_if({paid_on} {current})"),
            F.expr(f"sum(case when {paid_on} {last} then loan_amount else 0 end)"),
            F.expr(f"sum(case when {paid_on} {current} then loan_amount else 0 end)"),
        )
        .collect()
    )
    assert len(expected) == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def _pairs(spark, frames):
    frames["loan_application"].createOrReplaceTempView("a")
    frames["app_user_history"].createOrReplaceTempView("h")
    frames["install_event"].createOrReplaceTempView("i")
    return spark.sql(PAIRS)


def test_match_counts_keep_every_row(spark, split):
    made = busy(spark)
    frames = made.frames()
    got = attribution.history_matches(
        frames["loan_application"], frames["app_user_history"]
    ).collect()
    pairs = Counter(
        app[0]
        for app in made.apps
        for user, _, seen in made.history
        if app[1] is not None and app[1] == user and (seen - app[4]).total_seconds() < 3600
    )
    expected = {app[0]: pairs[app[0]] for app in made.apps}
    assert {row.id: row.history_matches for row in got} == expected


def test_attributed_rows_against_pairs(spark, split):
    frames = busy(spark).frames()
    got = attribution.attributed_rows(
        frames["loan_application"],
        frames["app_user_history"],
        frames["install_event"],
        PeriodAnchors.of(AS_OF),
    ).collect()
    expected = {r.id: r["count"] for r in _pairs(spark, frames).groupBy("id").count().collect()}
    assert {row.id: row.joined_rows for row in got} == expected


@pytest.mark.parametrize("kind", ["double", "decimal(18,4)", "bigint"])
def test_amounts_are_exact_and_of_their_type(spark, split, kind):
    """Ten small amounts, joined to three visits and one install each."""
    made = Made(spark)
    for _ in range(10):
        made.app("2000-03-10", "2000-03-11", amount="0.00" if kind == "bigint" else "1.00")
    for _ in range(3):
        made.visit(1, "a", "2000-03-09")
    made.install("a", "X", "2000-03-08")
    frames = made.frames()
    small = F.lit(4) if kind == "bigint" else F.lit("0.004")
    apps = frames["loan_application"].withColumn("loan_amount", small.cast(kind))
    rows = attribution.channel_measures(
        apps, frames["app_user_history"], frames["install_event"], PeriodAnchors.of(AS_OF)
    )
    plain = dict(apps.agg(F.sum("loan_amount").alias("current_disbursed_amt")).dtypes)
    assert dict(rows.dtypes)["current_disbursed_amt"] == plain["current_disbursed_amt"]
    (row,) = rows.collect()
    total = 120 if kind == "bigint" else 0.12
    assert float(row.current_disbursed_amt) == pytest.approx(total, abs=1e-12)
    assert (row.current_starts, row.current_disbursed) == (30, 30)


def test_a_report_starts_no_job(spark, made):
    made.app("2000-03-10").visit(1, "a", "2000-03-09").install("a", "X", "2000-03-08")
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in REPORTS:
            report(made.sources(), name, AS_OF)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
