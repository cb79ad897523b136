"""A stored partial aggregate by day, so that a daily report reads one day of applications.

The funnel measures are sums over two kinds of events: an application is created, and it is
disbursed. Both are kept by the day they fall on, one partition per day, with every label:

* ``starts``: applications by creation day;
* ``paid``: disbursals and amounts by disbursal day and creation day.

An application that is disbursed later adds a row to a later day of ``paid`` and changes
nothing in a closed day, so closing a day writes that day only. Writing it again replaces it:
a run that was lost halfway is repeated, and a day with late corrections is closed anew.

A report adds up closed days. Days that a bound cuts at an instant (the running day, and the
first day of the lookback) and days not closed are read from the applications themselves.
The one bound that falls within a day otherwise, the midnight that ends the last period, is
kept apart by flags.

The cube assumes that an application keeps its labels after its creation day is closed;
days whose applications changed must be closed again, with the days they were disbursed on.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens import constants as k
from lendlens.functions import classify
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators.aggregates import AMOUNTS, MEASURES, measure_terms
from lendlens.operators.filters import created_between_days, disbursed_between_days, lookback_150d
from lendlens.operators.projections import normalize_timestamps

LABELS = {
    "single_app_programme": classify.programme_single_app,
    "two_app_programme": classify.programme_two_app,
    "partner_bucket": classify.partner_bucket,
    "platform": classify.platform,
    "ticket_size": classify.ticket_size,
}

CREATED_DAY, PAID_DAY = "created_on", "paid_on"


def _label_columns(names: Iterable[str]) -> list[Column]:
    return [LABELS[name]().alias(name) for name in names]


def _at_midnight(time: str) -> Column:
    return F.col(time) == F.to_date(time).cast("timestamp_ntz")


def starts_by_day(apps: DataFrame) -> DataFrame:
    """Applications by creation day and labels; ``at_midnight`` sets its first instant apart."""
    rows = normalize_timestamps(apps).select(
        F.to_date("date_created").alias(CREATED_DAY),
        _at_midnight("date_created").alias("at_midnight"),
        *_label_columns(LABELS),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def paid_by_day(apps: DataFrame) -> DataFrame:
    """Disbursals by disbursal day, creation day and labels; ``blank`` lack an amount."""
    rows = normalize_timestamps(apps).select(
        F.to_date("disbursal_date").alias(PAID_DAY),
        _at_midnight("disbursal_date").alias("at_midnight"),
        F.to_date("date_created").alias(CREATED_DAY),
        *_label_columns(LABELS),
        "loan_amount",
    )
    return rows.groupBy(*(name for name in rows.columns if name != "loan_amount")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("loan_amount").alias("amount"),
        F.count_if(F.col("loan_amount").isNull()).alias("blank"),
    )


class DayCube:
    """The closed days under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")

    def close(self, apps: DataFrame, first: date, last: date) -> None:
        """Write the days from ``first`` to ``last``, in place of what they held.

        Closed days must follow one another without a gap. The span of closed days is
        written last, so days of a lost run count as open.
        """
        if last < first:
            raise ValueError(f"no days from {first} to {last}")
        span = self.closed()
        if span is not None:
            gap_before = (first - span[1]).days > 1
            gap_after = (span[0] - last).days > 1
            if gap_before or gap_after:
                raise ValueError(f"a gap between {first} to {last} and {span[0]} to {span[1]}")
        made = {
            "starts": (starts_by_day(created_between_days(apps, first, last)), CREATED_DAY),
            "paid": (paid_by_day(disbursed_between_days(apps, first, last)), PAID_DAY),
        }
        for name, (days, day) in made.items():
            self._write_days(days, name, day, first, last)
        if span is not None:
            first, last = min(first, span[0]), max(last, span[1])
        closed = self._spark.createDataFrame([(first, last)], "first date, last date")
        closed.coalesce(1).write.mode("append").parquet(f"{self._folder}/closed")

    def _write_days(self, df: DataFrame, name: str, day: str, first: date, last: date) -> None:
        """One file per day: the groups of a day are few next to its applications.

        Every day gets an empty row, so that a day that lost all its rows is replaced, too.
        """
        days = self._spark.range((last - first).days + 1)
        empty = days.select(
            F.date_add(F.lit(first), F.col("id").cast("int")).alias(day),
            F.lit(0).cast("long").alias("n"),
        )
        (
            df.unionByName(empty, allowMissingColumns=True)
            .repartition(day)
            .write.partitionBy(day)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(f"{self._folder}/{name}")
        )

    def closed(self) -> tuple[date, date] | None:
        """The first and the last closed day."""
        spans = self._stored("closed", T.StructType().add("first", "date").add("last", "date"))
        if spans is None:
            return None
        row = spans.agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
        return None if row.first is None else (row.first, row.last)

    def _stored(self, name: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self._spark.read.schema(schema).parquet(f"{self._folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def pivot(self, apps: DataFrame, anchors: PeriodAnchors, labels: Iterable[str]) -> DataFrame:
        """The six measures of the lookback by labels, as ``period_pivot`` makes them."""
        labels = list(labels)
        span = self.closed()
        parts = [_open_events(apps, anchors, labels, span)]
        if span is not None:
            starts = self._stored("starts", starts_by_day(apps).schema)
            paid = self._stored("paid", paid_by_day(apps).schema)
            if starts is not None:
                parts.append(_closed_starts(starts, anchors, labels, span))
            if paid is not None:
                parts.append(_closed_paid(paid, anchors, labels, span))
        events = parts[0]
        for part in parts[1:]:
            events = events.unionByName(part)
        return _summed(events, labels, apps.schema["loan_amount"].dataType)


def _lookback_day(anchors: PeriodAnchors) -> Column:
    return F.to_date(anchors.instant_days_ago(k.LOOKBACK_DAYS))


def _is_closed(day: Column, span: tuple[date, date] | None) -> Column:
    return F.lit(False) if span is None else day.between(F.lit(span[0]), F.lit(span[1]))


def _from_starts(created: Column, anchors: PeriodAnchors, span) -> Column:
    """Whether closed days stand for the creations of a day, and no bound cuts the day."""
    return _is_closed(created, span) & (created != anchors.today) & (created != _lookback_day(anchors))


def _from_paid(paid: Column, created: Column, anchors: PeriodAnchors, span) -> Column:
    whole = (paid != anchors.today) & (created != _lookback_day(anchors))
    return F.coalesce(_is_closed(paid, span) & whole, F.lit(False))


def _events(df: DataFrame, labels: list[str], **values: Column) -> DataFrame:
    """One shape for all parts: labels, rows that make a group, measures, blanks by period."""
    return df.select(*labels, *(value.alias(name) for name, value in values.items()))


def _open_events(apps: DataFrame, anchors: PeriodAnchors, labels: list[str], span) -> DataFrame:
    """What applications add whose creation or disbursal no closed day holds whole."""
    created, paid = F.to_date("date_created"), F.to_date("disbursal_date")
    start_open = ~_from_starts(created, anchors, span)
    paid_open = paid.isNotNull() & ~_from_paid(paid, created, anchors, span)
    recent = lookback_150d(apps, anchors)
    if span is not None:
        # Days outside the closed ones and days cut at an instant, as ranges that reach the scan.
        before, after = F.lit(span[0]), F.lit(span[1])
        cut = [created == anchors.today, created == _lookback_day(anchors), paid == anchors.today]
        out = [created < before, created > after, paid < before, paid > after]
        wanted = out[0]
        for one in (*out[1:], *cut):
            wanted = wanted | one
        recent = recent.filter(wanted)
    rows = normalize_timestamps(recent).select(
        "date_created",
        "disbursal_date",
        "loan_amount",
        start_open.cast("long").alias("starts"),
        F.coalesce(paid_open, F.lit(False)).cast("long").alias("paid"),
        *_label_columns(labels),
    )
    n, amount = F.col("paid"), F.when(F.col("paid") > 0, F.col("loan_amount"))
    terms = measure_terms(
        anchors, "ts", F.col("date_created"), F.col("disbursal_date"), n, amount
    )
    starts = measure_terms(
        anchors, "ts", F.col("date_created"), F.col("disbursal_date"), F.col("starts"), amount
    )
    blank = F.col("loan_amount").isNull().cast("long")
    return _events(
        rows,
        labels,
        rows=F.col("starts"),
        last_starts=starts["last_starts"],
        current_starts=starts["current_starts"],
        last_disbursed=terms["last_disbursed"],
        current_disbursed=terms["current_disbursed"],
        last_disbursed_amt=terms["last_disbursed_amt"],
        current_disbursed_amt=terms["current_disbursed_amt"],
        last_blank=terms["last_disbursed"] * blank,
        current_blank=terms["current_disbursed"] * blank,
    )


def _in_last(day: Column, anchors: PeriodAnchors) -> Column:
    """Of the closing day of the last period only its first instant counts."""
    end = anchors.same_day_last_month_date
    return (day >= anchors.last_month_first) & (
        (day < end) | ((day == end) & F.col("at_midnight"))
    )


def _in_current(day: Column, anchors: PeriodAnchors) -> Column:
    return (day >= anchors.current_month_first) & (day < anchors.today)


def _term(wanted: Column, value: Column) -> Column:
    return F.when(wanted, value).otherwise(F.lit(0))


def _closed_starts(starts: DataFrame, anchors: PeriodAnchors, labels: list[str], span) -> DataFrame:
    day, n = F.col(CREATED_DAY), F.col("n")
    kept = starts.filter((n > 0) & (day > _lookback_day(anchors)) & _from_starts(day, anchors, span))
    zero = F.lit(0).cast("long")
    return _events(
        kept,
        labels,
        rows=n,
        last_starts=_term(_in_last(day, anchors), n),
        current_starts=_term(_in_current(day, anchors), n),
        last_disbursed=zero,
        current_disbursed=zero,
        last_disbursed_amt=zero,
        current_disbursed_amt=zero,
        last_blank=zero,
        current_blank=zero,
    )


def _closed_paid(paid: DataFrame, anchors: PeriodAnchors, labels: list[str], span) -> DataFrame:
    """Only days from the first of last month are read: earlier disbursals count in no period."""
    day, created = F.col(PAID_DAY), F.col(CREATED_DAY)
    kept = paid.filter(
        (F.col("n") > 0)
        & (day >= anchors.last_month_first)
        & (created > _lookback_day(anchors))
        & _from_paid(day, created, anchors, span)
    )
    last, current = _in_last(day, anchors), _in_current(day, anchors)
    zero = F.lit(0).cast("long")
    return _events(
        kept,
        labels,
        rows=zero,
        last_starts=zero,
        current_starts=zero,
        last_disbursed=_term(last, F.col("n")),
        current_disbursed=_term(current, F.col("n")),
        last_disbursed_amt=_term(last, F.col("amount")),
        current_disbursed_amt=_term(current, F.col("amount")),
        last_blank=_term(last, F.col("blank")),
        current_blank=_term(current, F.col("blank")),
    )


def _summed(events: DataFrame, labels: list[str], amount: T.DataType) -> DataFrame:
    """Sums by label. An amount is NULL where every row of the group is paid without one."""
    summed = events.groupBy(*labels).agg(
        *(F.sum(name).alias(name) for name in ("rows", *MEASURES, "last_blank", "current_blank"))
    )
    kind = amount
    if isinstance(amount, T.DecimalType):
        kind = T.DecimalType(min(38, amount.precision + 10), amount.scale)
    elif isinstance(amount, T.IntegerType):
        kind = T.LongType()

    def measure(name: str) -> Column:
        if name not in AMOUNTS:
            return F.col(name)
        blank = F.col(name.replace("disbursed_amt", "blank"))
        value = F.coalesce(F.col(name), F.lit(0)).cast(kind)
        return F.when(blank < F.col("rows"), value).alias(name)

    return summed.select(*labels, *(measure(name) for name in MEASURES))
