"""Reports from closed days against reports from applications."""

import random
from datetime import date, datetime, timedelta

import pytest

from lendlens import constants as k
from lendlens.functions.anchors import PeriodAnchors
from lendlens.plans import families
from lendlens.plans.day_cube import DayCube
from lendlens.plans.reports import report, reports
from tests.conftest import APPLICATION, Made

#: A day amid a month, the first, a clamped day, a leap day, midnight itself.
EDGES = [
    "2000-03-15 13:30:00",
    "2000-03-15 00:00:00",
    "2000-03-01 09:00:00",
    "2000-03-31 23:59:59.999999",
    "2000-02-29 12:00:00",
    "2000-01-31 18:00:00",
]
FUNNELS = [families.month_over_month, families.ticket_sizes]


def times_of(rng, as_of):
    """Instants at and beside every edge of an instant's periods and lookback, and others."""
    now = datetime.fromisoformat(as_of)
    midnight = datetime(now.year, now.month, now.day)
    first = midnight.replace(day=1)
    last_first = (first - timedelta(days=1)).replace(day=1)
    back = now - timedelta(days=k.LOOKBACK_DAYS)
    same = min(now.day, (first - timedelta(days=1)).day)
    edges = [now, midnight, first, last_first, back, last_first.replace(day=same)]
    beside = [e + timedelta(microseconds=d) for e in edges for d in (-1, 0, 1)]
    beside += [e + timedelta(days=d, hours=3) for e in edges for d in (-1, 1)]
    return beside + [now - timedelta(minutes=rng.randrange(260_000)) for _ in range(20)]


@pytest.fixture(scope="module")
def apps(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = []
    for as_of in EDGES:
        times = times_of(rng, as_of)
        for created in [*times, None]:
            for paid in (None, created, rng.choice(times), rng.choice(times)):
                product, app = rng.choice(["1", "6", None, "2"]), rng.choice([k.APP_MAIN, k.APP_TOPUP, None])
                amount = rng.choice([None, "10.25", "99.50"])
                rows.append((created, paid, product, app, amount, rng.choice([3, 6, 9, None])))
    # Groups of one application, paid without an amount.
    rows.append((datetime(2000, 3, 2), datetime(2000, 3, 3), "6", "com.phonepe.app", None, 99))
    made = spark.createDataFrame(
        rows, "date_created timestamp_ntz, disbursal_date timestamp_ntz, loan_product_id string,"
        " app_name string, amount string, loan_tenure int",
    ).selectExpr(
        "monotonically_increasing_id() as id", "1L as user_id_ref", "loan_product_id", "app_name",
        "date_created", "disbursal_date", "cast(amount as decimal(18,2)) as loan_amount", "loan_tenure",
    )
    path = str(tmp_path_factory.mktemp("apps"))
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sources_of(spark, apps):
    made = Made(spark)
    return made.sources().__class__(spark, (made.frames() | {"loan_application": apps}).__getitem__)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def cubes(spark, apps, tmp_path_factory):
    """No day closed; all before the first instant's day in two goes, one day again; up to later."""
    spans = [
        [],
        [(date(1999, 6, 1), date(2000, 2, 20)), (date(2000, 2, 21), date(2000, 3, 14)),
         (date(2000, 3, 1), date(2000, 3, 1))],
        [(date(2000, 1, 5), date(2000, 5, 1))],
    ]
    made = []
    for span in spans:
        cube = DayCube(spark, str(tmp_path_factory.mktemp("cube")))
        for first, last in span:
            cube.close(apps, first, last)
        made.append(cube)
    return made


@pytest.mark.parametrize("as_of", EDGES)
def test_equal_to_a_full_run(spark, apps, cubes, as_of):
    plain = sources_of(spark, apps)
    anchors = PeriodAnchors.of(as_of)
    for funnel in FUNNELS:
        full = funnel(plain, anchors)
        for cube in cubes:
            part = funnel(plain.with_day_cube(cube), anchors)
            assert [f.dataType for f in part.schema] == [f.dataType for f in full.schema]
            assert rows_of(part) == rows_of(full)


def test_reports_together(spark, apps, cubes):
    plain = sources_of(spark, apps)
    names = ["rpt_changes_mom", "rpt_partner_ats", "rpt_topup_ats"]
    with reports(plain.with_day_cube(cubes[1]), names, EDGES[0]) as made:
        for name in names:
            assert rows_of(made[name]) == rows_of(report(plain, name, EDGES[0]))


def test_days_are_replaced(spark, apps, tmp_path):
    """A day closed again takes on late corrections, also where all its rows went."""
    cube = DayCube(spark, str(tmp_path))
    cube.close(apps, date(1999, 6, 1), date(2000, 3, 14))
    later = apps.filter("date_created < '2000-03-10' or date_created >= '2000-03-15'")
    cube.close(later, date(2000, 3, 10), date(2000, 3, 14))
    cube.close(later, date(1999, 6, 1), date(2000, 3, 14))
    plain = sources_of(spark, later)
    anchors = PeriodAnchors.of(EDGES[0])
    assert rows_of(families.partners(plain.with_day_cube(cube), anchors)) == rows_of(
        families.partners(plain, anchors)
    )


def test_gaps_and_empty(spark, tmp_path):
    cube = DayCube(spark, str(tmp_path))
    none = spark.createDataFrame([], APPLICATION)
    assert cube.closed() is None
    cube.close(none, date(2000, 3, 1), date(2000, 3, 2))
    with pytest.raises(ValueError, match="gap"):
        cube.close(none, date(2000, 3, 5), date(2000, 3, 6))
    cube.close(none, date(2000, 2, 29), date(2000, 2, 29))
    assert cube.closed() == (date(2000, 2, 29), date(2000, 3, 2))
    plain = sources_of(spark, none).with_day_cube(cube)
    assert families.partners(plain, PeriodAnchors.of(EDGES[0])).collect() == []


def test_only_open_days_are_read(spark, apps, cubes):
    """The days cut at an instant and those not closed reach the scan of the applications."""
    df = families.partners(sources_of(spark, apps).with_day_cube(cubes[1]), PeriodAnchors.of(EDGES[0]))
    text = df._jdf.queryExecution().executedPlan().toString()
    bounds = next(line for line in text.splitlines() if "FileScan" in line and "app_name" in line)
    assert "GreaterThanOrEqual(date_created,1999-10-17T13:30)" in bounds
    assert "GreaterThanOrEqual(date_created,2000-03-15T00:00)" in bounds
    assert "GreaterThanOrEqual(disbursal_date,2000-03-15T00:00)" in bounds
    assert "LessThan(date_created,1999-10-18T00:00)" in bounds
