"""Row-level projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.anchors import INSTANT, PeriodAnchors


def instant(column: str) -> Column:
    """A date or timestamp column as a zone-free timestamp (midnight for a date)."""
    return F.col(column).cast(INSTANT)


def month_of(column: str) -> Column:
    """First instant of the month; NULL stays NULL."""
    return F.trunc(F.to_date(column), "MM").cast(INSTANT)


def normalize_timestamps(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: instant(name) for name in ("date_created", "disbursal_date")}
    )


def to_dates(df: DataFrame) -> DataFrame:
    """Event times at day grain; all other columns are kept."""
    return df.withColumns(
        {
            "created_date": F.to_date("date_created"),
            "disbursal_date": F.to_date("disbursal_date"),
        }
    )


def month_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"created_month": month_of("date_created"), "disbursed_month": month_of("disbursal_date")}
    )


def metric_pair(df: DataFrame, bucket: str, last: str, current: str) -> DataFrame:
    """One metric for both periods by bucket; the programme column is dropped."""
    return df.select(bucket, last, current)


def with_params(df: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    """Attach the anchors to every row, as literals instead of a join to one row."""
    return df.select("*", *(v.alias(n) for n, v in anchors.instants().items()))
