"""Ratios and changes over the six period measures.

Ratios are taken in double precision on unrounded operands; only the outermost
value is rounded. A zero denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors


def _ratio(part: str, whole: str) -> str:
    return f"(cast({part} as double) / nullif(cast({whole} as double), 0D))"


def _change(last: str, current: str) -> Column:
    change = f"({current} - {last})"
    return F.expr(f"round({_ratio(change, last)} * 100, 2)")


def _conversion(period: str) -> str:
    return _ratio(f"{period}_disbursed", f"{period}_starts")


def _ats(period: str) -> str:
    return _ratio(f"{period}_disbursed_amt", f"{period}_disbursed")


def change_in_starts_pct() -> Column:
    return _change("last_starts", "current_starts")


def conversion(period: str) -> Column:
    """Disbursals over starts of the same period; not a cohort's, so it may exceed one."""
    return F.expr(f"round({_conversion(period)}, 4)")


def change_in_conversion_pct() -> Column:
    return _change(_conversion("last"), _conversion("current"))


def ats(period: str) -> Column:
    """Average ticket size."""
    return F.expr(f"round({_ats(period)}, 2)")


def change_in_ats_pct() -> Column:
    return _change(_ats("last"), _ats("current"))


def funnel_metrics() -> dict[str, Column]:
    return {
        "change_in_starts_pct": change_in_starts_pct(),
        "last_conversion": conversion("last"),
        "current_conversion": conversion("current"),
        "change_in_conversion_pct": change_in_conversion_pct(),
        "last_ats": ats("last"),
        "current_ats": ats("current"),
        "change_in_ats_pct": change_in_ats_pct(),
    }


def add_funnel_metrics(df: DataFrame) -> DataFrame:
    return df.select("*", *(value.alias(name) for name, value in funnel_metrics().items()))


# Disbursed volume. Days are whole calendar days; the running day is left out.


def _volume(wanted: Column) -> Column:
    return F.sum(F.when(wanted, F.col("loan_amount")).otherwise(F.lit(0)))


def _disbursed_on() -> Column:
    return F.to_date("disbursal_date")


def prev_month_mtd(a: PeriodAnchors) -> Column:
    day = _disbursed_on()
    return _volume((day >= a.last_month_first) & (day < a.same_day_last_month_date))


def current_month_mtd(a: PeriodAnchors) -> Column:
    day = _disbursed_on()
    return _volume((day >= a.current_month_first) & (day < a.today))


def run_rate(to_date: Column, a: PeriodAnchors) -> Column:
    """Linear projection of a month-to-date amount to the whole month."""
    share = F.dayofmonth(a.last_day_of_month).cast("double") / F.dayofmonth(a.yesterday)
    return F.round(to_date.cast("double") * share, 2)


def current_month_projection(a: PeriodAnchors) -> Column:
    return run_rate(current_month_mtd(a), a)


def last_month_total(a: PeriodAnchors) -> Column:
    return _volume(_disbursed_on().between(a.last_month_first, a.last_day_of_last_month))
