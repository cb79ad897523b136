"""Two-period conditional aggregation.

A period pivot is a single grouped aggregate over base rows: every condition reads
row columns only, so partial aggregation leaves one row per group and task before
the shuffle. Rows may carry a multiplicity (``copies``) in place of repeated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors

STARTS = ("last_starts", "current_starts")
DISBURSED = ("last_disbursed", "current_disbursed")
AMOUNTS = ("last_disbursed_amt", "current_disbursed_amt")
MEASURES = STARTS + DISBURSED + AMOUNTS


def measure_terms(
    anchors: PeriodAnchors,
    grain: str,
    created: Column,
    disbursed: Column,
    rows: Column,
    amount: Column,
) -> dict[str, Column]:
    """What one row adds to each of the six measures."""
    if grain == "date":
        created, disbursed = F.to_date(created), F.to_date(disbursed)
    last, current = anchors.last_period(grain), anchors.current_period(grain)
    paid_last, paid_current = last.holds(disbursed), current.holds(disbursed)

    def term(wanted: Column, value: Column) -> Column:
        return F.when(wanted, value).otherwise(0)

    return {
        "last_starts": term(last.holds(created), rows),
        "current_starts": term(current.holds(created), rows),
        "last_disbursed": term(paid_last, rows),
        "current_disbursed": term(paid_current, rows),
        "last_disbursed_amt": term(paid_last, amount),
        "current_disbursed_amt": term(paid_current, amount),
    }


def period_pivot(
    df: DataFrame,
    keys: Sequence[str],
    anchors: PeriodAnchors,
    grain: str = "ts",
    copies: str | None = None,
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """``keys`` plus the measures, over one row per application (times ``copies``)."""
    rows = F.lit(1) if copies is None else F.col(copies)
    amount = F.col("loan_amount") if copies is None else F.col("loan_amount") * F.col(copies)
    terms = measure_terms(
        anchors, grain, F.col("date_created"), F.col("disbursal_date"), rows, amount
    )
    return df.groupBy(*keys).agg(*(F.sum(terms[name]).alias(name) for name in measures))


def disbursed_amount(flag: Column, amount: Column) -> Column:
    return F.sum(F.when(flag.isNotNull(), amount).otherwise(F.lit(0)))


def pre_grain(
    df: DataFrame, keys: Sequence[str], grain: str = "ts", with_product: bool = True
) -> DataFrame:
    """Row counts and disbursed amounts by key, creation time and disbursal time."""
    if grain == "date":
        df = df.withColumns(
            {
                "date_created": F.to_date("date_created"),
                "disbursal_date": F.to_date("disbursal_date"),
            }
        )
    product = ["loan_product_id"] if with_product else []
    return df.groupBy(*product, *keys, "date_created", "disbursal_date").agg(
        F.count(F.lit(1)).alias("count"),
        disbursed_amount(F.col("disbursal_date"), F.col("loan_amount")).alias("amount"),
    )


def pivot_pre_grain(
    grouped: DataFrame, keys: Sequence[str], anchors: PeriodAnchors, grain: str = "ts"
) -> DataFrame:
    """The period pivot over the result of ``pre_grain``."""
    terms = measure_terms(
        anchors,
        grain,
        F.col("date_created"),
        F.col("disbursal_date"),
        F.col("count"),
        F.col("amount"),
    )
    return grouped.groupBy(*keys).agg(*(F.sum(terms[name]).alias(name) for name in MEASURES))


def two_level(
    df: DataFrame,
    keys: Sequence[str],
    anchors: PeriodAnchors,
    grain: str = "ts",
    with_product: bool = True,
) -> DataFrame:
    """Same result as ``period_pivot``, with the intermediate grain spelled out."""
    return pivot_pre_grain(pre_grain(df, keys, grain, with_product), keys, anchors, grain)
