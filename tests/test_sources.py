from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lendlens.operators import filters
from lendlens.functions.anchors import PeriodAnchors
from lendlens.plans.reports import report
from lendlens.session import configure
from lendlens.sources.schemas import SCHEMAS, Layout, SchemaError, checked
from lendlens.sources.tables import Sources
from tests.conftest import AS_OF


def test_missing_column_is_named(made):
    apps = made.app("2000-03-01").frames()["loan_application"]
    with pytest.raises(SchemaError, match="loan_application: no column loan_tenure"):
        checked(apps.drop("loan_tenure"), "loan_application")


def test_wrong_type_is_named(made):
    apps = made.app("2000-03-01").frames()["loan_application"]
    with pytest.raises(SchemaError, match="loan_application.app_name: int not accepted"):
        checked(apps.withColumn("app_name", F.lit(1)), "loan_application")


def test_extra_columns_are_cut(made):
    apps = made.app("2000-03-01").frames()["loan_application"].withColumn("more", F.lit(1))
    assert checked(apps, "loan_application").columns == list(SCHEMAS["loan_application"])


def test_catalog_tables(spark, made):
    frames = made.app("2000-03-01").frames()
    for name, df in frames.items():
        df.createOrReplaceTempView(f"lending_{name}")
    sources = Sources.from_catalog(spark, {name: f"lending_{name}" for name in frames})
    assert report(sources, "rpt_changes_mom", AS_OF).first().current_starts == 1


def test_dates_for_disbursals_and_whole_amounts(made):
    frames = made.app("2000-02-20", "2000-03-05 17:00:00", amount="12.00").frames()
    frames["loan_application"] = frames["loan_application"].withColumns(
        {
            "disbursal_date": F.to_date("disbursal_date"),
            "loan_amount": F.col("loan_amount").cast("bigint"),
        }
    )
    row = report(Sources(made.spark, frames.__getitem__), "rpt_changes_mom", AS_OF).first()
    assert (row.current_disbursed, row.current_disbursed_amt) == (1, 12)


DAY = "to_date(date_created)"


@pytest.mark.parametrize(
    "value, layout",
    [
        (DAY, Layout("laid_out", "date_created")),
        (f"trunc({DAY}, 'MM')", Layout("laid_out", "date_created", "month")),
        (f"trunc({DAY}, 'YYYY')", Layout("laid_out", "date_created", "year")),
        (f"if(id % 2 = 0, {DAY}, null)", Layout("laid_out", "date_created")),
        ("to_date(date_created - interval 8 hours)", Layout("laid_out", "date_created", zone="America/Los_Angeles")),
    ],
)
def test_layouts_keep_every_row(made, value, layout):
    for day in range(1, 31):
        made.app(f"1999-10-{day:02} 03:00:00", f"2000-01-{day:02} 03:00:00")
    apps = made.app("1999-10-17 13:29:00").app("1999-10-17 13:30:00").frames()["loan_application"]
    dated = checked(apps.withColumn("laid_out", F.expr(value)), "loan_application", [layout])
    anchors = PeriodAnchors.of(AS_OF)
    for bounded in (filters.lookback_150d, filters.lookback_60d, filters.either_date_60d):
        assert bounded(dated, anchors).count() == bounded(apps, anchors).count()
    assert filters.lookback_150d(dated, anchors).count() == 14


def test_undeclared_columns_bound_nothing(made):
    apps = made.app("2000-03-01").frames()["loan_application"]
    wrong = apps.withColumn("created_day", F.lit("1990-01-01").cast("date"))
    assert checked(wrong, "loan_application").columns == list(SCHEMAS["loan_application"])
    assert filters.lookback_150d(wrong, PeriodAnchors.of(AS_OF)).count() == 1


@pytest.mark.parametrize(
    "value, layout",
    [
        ("'2000-03'", Layout("laid_out", "date_created")),
        ("1", Layout("laid_out", "date_created")),
        (DAY, Layout("missing", "date_created")),
        (DAY, Layout("laid_out", "created")),
        (DAY, Layout("laid_out", "date_created", "week")),
    ],
)
def test_wrong_layouts_are_named(made, value, layout):
    apps = made.app("2000-03-01").frames()["loan_application"].withColumn("laid_out", F.expr(value))
    with pytest.raises(SchemaError, match=f"loan_application.{layout.column}"):
        checked(apps, "loan_application", [layout])


def test_amounts_of_many_places_are_named(made):
    apps = made.app("2000-03-01").frames()["loan_application"]
    apps = apps.withColumn("loan_amount", F.lit(1).cast("decimal(20,8)"))
    with pytest.raises(SchemaError, match="more than 6 decimal places"):
        checked(apps, "loan_application")


def test_datasets_of_other_names_and_paths(spark, made, tmp_path):
    frames = made.app("2000-03-10").visit(1, "a", "2000-03-09").install("a", "X", "2000-03-08").frames()
    here, there = tmp_path / "here", tmp_path / "there" / "appsflyer_install_event"
    for name, df in frames.items():
        path = there if name == "install_event" else here / f"the_{name}"
        df.write.parquet(str(path))
    names = {name: f"the_{name}" for name in frames} | {"install_event": str(there)}
    sources = Sources.from_parquet(spark, str(here), names)
    assert report(sources, "rpt_channel_starts", AS_OF).first().current_starts == 1


@pytest.mark.parametrize(
    "as_of",
    [
        datetime(2000, 3, 15, 2, 0, tzinfo=timezone(timedelta(hours=5, minutes=30))),
        "2000-03-15T02:00:00+05:30",
        "2000-03-14T20:30:00Z",
        datetime(2000, 3, 14, 20, 30),
        "2000-03-14 20:30:00",
        "2000-3-14 20:30",
        "2000-03-14T20:30:00.000000Z",
        "2000-03-15 02:00:00 Asia/Kolkata",
        "2000-03-15T02:00 Asia/Kolkata",
        "2000-03-15 02:00:00 +5:30",
        "2000-03-15 02:00:00+0530",
        "2000-03-15 02:00:00 UTC+05:30",
        "2000-03-15 02:00:00 gmt+5:30",
        "2000-03-14 12:30:00-08",
        "2000-03-14 12:30:00 America/Los_Angeles",
        "2000-03-14 20:30:00 UTC",
        datetime(2000, 3, 15, 2, 0, tzinfo=ZoneInfo("Asia/Kolkata")),
    ],
)
def test_as_of_is_an_instant(spark, as_of):
    now = spark.range(1).select(PeriodAnchors.of(as_of).now).first()[0]
    assert now == datetime(2000, 3, 14, 20, 30)


@pytest.mark.parametrize(
    "text",
    [
        "2000-03-15 02:00:00 IST",
        "2000-03-15 02:00:00 Asia/Nowhere",
        "2000-03-15 02:00:00 ../etc/passwd",
        "2000-03-15 02:00:00 +25:00",
        "2000-03-15 02:00:00 +05:75",
        "2000-03-15 02:00:00 UTC UTC",
        "2000-02-30",
        "2000-03-15 25:00",
        "yesterday",
        "20000315",
        "",
    ],
)
def test_text_that_is_no_instant_is_an_error(text):
    with pytest.raises(ValueError):
        PeriodAnchors.of(text)


def test_clock_changes_of_a_zone(spark):
    """The repeated hour counts as before the change, the skipped one too."""
    for text, hour in (("2000-10-29 01:30 America/New_York", 5), ("2000-04-02 02:30 America/New_York", 7)):
        now = spark.range(1).select(PeriodAnchors.of(text).now).first()[0]
        assert (now.hour, now.minute) == (hour, 30)


def test_the_clock_is_read_once(spark):
    anchors = PeriodAnchors.of()
    reads = [spark.range(1).select(anchors.now).first()[0] for _ in range(2)]
    assert reads[0] == reads[1]
    clock = datetime.now(UTC).replace(tzinfo=None)
    assert timedelta(0) <= clock - reads[0] < timedelta(minutes=5)


@pytest.mark.parametrize("days", [-1, 0, 1])
def test_today_is_the_clocks_day(made, days):
    """Rows on either side of today."""
    today = datetime.now(UTC).replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0)
    made.app(str(today + timedelta(days=days)))
    anchors = PeriodAnchors.of()
    apps = made.frames()["loan_application"]
    assert apps.filter(F.to_date("date_created") == anchors.today).count() == (days == 0)


def test_relations_are_opened_when_used(spark, made):
    frames = made.app("2000-03-01").frames()
    opened = []
    sources = Sources(spark, lambda name: opened.append(name) or frames[name])
    report(sources, "rpt_changes_mom", AS_OF)
    assert opened == ["loan_application"]


def test_clock_is_the_default(made):
    made.app("2000-03-01")
    assert report(made.sources(), "rpt_changes_mom").count() == 0


def test_session_settings(spark):
    assert configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"
