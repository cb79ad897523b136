"""Date lookbacks and row predicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions.anchors import PeriodAnchors
from lendlens.sources.schemas import layout_bound

CREATED, DISBURSED = "date_created", "disbursal_date"


def _pruned(df: DataFrame, of: str, day: Column) -> DataFrame:
    """Without the partitions that hold no row with ``of`` on or after a day."""
    bound = layout_bound(df, of, day)
    return df if bound is None else df.filter(bound)


def created_since(df: DataFrame, bound: Column) -> DataFrame:
    """Rows created at or after an instant.

    The literal takes the column's type, never the other way round, so the bound
    reaches the scan; a declared layout gets the matching bound and prunes partitions.
    """
    kept = df.filter(F.col(CREATED) >= bound.cast(df.schema[CREATED].dataType))
    return _pruned(kept, CREATED, F.to_date(bound))


def created_since_day(df: DataFrame, bound: Column) -> DataFrame:
    return _pruned(df.filter(F.to_date(CREATED) >= bound), CREATED, bound)


def lookback_150d(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    return created_since(df, anchors.instant_days_ago(k.LOOKBACK_DAYS))


def lookback_60d(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    return created_since_day(df, anchors.days_ago(k.RECENT_DAYS))


def created_recently(anchors: PeriodAnchors) -> Column:
    return F.to_date(CREATED) >= anchors.days_ago(k.RECENT_DAYS)


def disbursed_recently(anchors: PeriodAnchors) -> Column:
    return F.to_date(DISBURSED) >= anchors.days_ago(k.RECENT_DAYS)


def disbursed_60d(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    kept = df.filter(disbursed_recently(anchors))
    return _pruned(kept, DISBURSED, anchors.days_ago(k.RECENT_DAYS))


def either_date_60d(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    """One row per application that meets either bound.

    Partitions go only where both dates are laid out, as each rules out half the bound.
    """
    kept = df.filter(created_recently(anchors) | disbursed_recently(anchors))
    day = anchors.days_ago(k.RECENT_DAYS)
    created, disbursed = (layout_bound(df, of, day) for of in (CREATED, DISBURSED))
    if created is None or disbursed is None:
        return kept
    return kept.filter(created | disbursed)


def disbursed_since_last_month(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    kept = df.filter(F.to_date(DISBURSED) >= anchors.last_month_first)
    return _pruned(kept, DISBURSED, anchors.last_month_first)


def among(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*labels))


def not_like(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.filter(~F.col(column).contains(part))


def _between_days(df: DataFrame, of: str, first: date, last: date) -> DataFrame:
    """Whole days of a time, both included, as bounds that reach the scan."""
    day = F.to_date(of)
    kept = df.filter((day >= F.lit(first)) & (day <= F.lit(last)))
    return _pruned(kept, of, F.lit(first))


def created_between_days(df: DataFrame, first: date, last: date) -> DataFrame:
    return _between_days(df, CREATED, first, last)


def disbursed_between_days(df: DataFrame, first: date, last: date) -> DataFrame:
    return _between_days(df, DISBURSED, first, last)
