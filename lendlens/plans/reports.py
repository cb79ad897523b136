"""The 22 reports by name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from lendlens import constants as k
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import filters
from lendlens.operators.projections import metric_pair
from lendlens.operators.results import ordered
from lendlens.plans import families
from lendlens.sources.tables import Sources

Family = Callable[[Sources, PeriodAnchors], DataFrame]


@dataclass(frozen=True)
class Report:
    family: Family
    finish: Callable[[DataFrame], DataFrame]


def _programme_rows(label: str, second_key: str) -> Callable[[DataFrame], DataFrame]:
    def finish(df: DataFrame) -> DataFrame:
        return ordered(filters.among(df, "programme", [label]), "programme", second_key)

    return finish


def _all_but_others(df: DataFrame) -> DataFrame:
    return ordered(filters.not_like(df, "programme", "Others"), "programme")


def _by_programme(df: DataFrame) -> DataFrame:
    return ordered(df, "programme")


def _repeat_buckets(family: Family) -> Family:
    def table(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
        repeat = filters.among(
            family(sources, anchors), "programme", [k.MVL_REPEAT, k.DP_REPEAT]
        )
        return filters.among(
            repeat, "repeat_bucket", [k.BUCKET_LOW_AND_GROW, k.BUCKET_STARTER, k.BUCKET_REGULAR]
        )

    return table


_REPEAT_CUSTOMERS = _repeat_buckets(families.repeat_customers)
_REPEAT_STARTS = _repeat_buckets(families.repeat_starts)


def _repeat_pair(last: str, current: str) -> Callable[[DataFrame], DataFrame]:
    def finish(df: DataFrame) -> DataFrame:
        return ordered(metric_pair(df, "repeat_bucket", last, current), "repeat_bucket")

    return finish


def _repeat_starts(df: DataFrame) -> DataFrame:
    shown = df.select("repeat_bucket", "last_starts", "current_starts", "change_in_starts_pct")
    return ordered(shown, "repeat_bucket")


_PARTNERS = Report(families.partners, _programme_rows(k.DP_NEW, "partner_bucket"))
_PLATFORMS = Report(families.platforms, _programme_rows(k.MVL_NEW, "platform"))
_CHANNELS = Report(families.channels, _programme_rows(k.MVL_NEW, "campaign_type"))
_TICKETS = Report(families.ticket_sizes, _programme_rows(k.TOPUP, "ticket_size"))

# The reports of one group share one table; a reader picks the metric's columns.
REPORTS: dict[str, Report] = {
    "rpt_changes_mom": Report(families.month_over_month, _all_but_others),
    "rpt_volume_projection": Report(families.volume_projection, _by_programme),
    "rpt_partner_disb_amount": _PARTNERS,
    "rpt_partner_starts": _PARTNERS,
    "rpt_partner_conversion": _PARTNERS,
    "rpt_partner_ats": _PARTNERS,
    "rpt_platform_ats": _PLATFORMS,
    "rpt_platform_conversion": _PLATFORMS,
    "rpt_platform_disb_amount": _PLATFORMS,
    "rpt_platform_starts": _PLATFORMS,
    "rpt_channel_starts": _CHANNELS,
    "rpt_channel_disb_amount": _CHANNELS,
    "rpt_channel_ats": _CHANNELS,
    "rpt_channel_conversion": _CHANNELS,
    "rpt_repeat_disb_amount": Report(
        _REPEAT_CUSTOMERS, _repeat_pair("last_disbursed_amt", "current_disbursed_amt")
    ),
    "rpt_repeat_ats": Report(_REPEAT_CUSTOMERS, _repeat_pair("last_ats", "current_ats")),
    "rpt_repeat_conversion": Report(
        _REPEAT_CUSTOMERS, _repeat_pair("last_conversion", "current_conversion")
    ),
    "rpt_repeat_starts": Report(_REPEAT_STARTS, _repeat_starts),
    "rpt_topup_conversion": _TICKETS,
    "rpt_topup_disb_amount": _TICKETS,
    "rpt_topup_starts": _TICKETS,
    "rpt_topup_ats": _TICKETS,
}


def report(sources: Sources, name: str, as_of: datetime | str | None = None) -> DataFrame:
    """One report; without ``as_of`` it is as of the clock."""
    chosen = REPORTS[name]
    return chosen.finish(chosen.family(sources, PeriodAnchors.of(as_of)))


@contextmanager
def reports(
    sources: Sources, names: Iterable[str], as_of: datetime | str | None = None
) -> Iterator[dict[str, DataFrame]]:
    """Several reports that share their work while the context is open.

    Funnel reports roll up one cube, so the applications are scanned once for them all;
    a table that several reports need is computed once. Both are small and persisted.
    """
    anchors = PeriodAnchors.of(as_of)
    wanted = {name: REPORTS[name] for name in names}
    uses = Counter(chosen.family for chosen in wanted.values())
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return df

    funnels = [family for family in uses if isinstance(family, families.Funnel)]
    cube = keep(families.funnel_cube(sources, anchors)) if len(funnels) > 1 else None
    tables = {}
    for family, readers in uses.items():
        if cube is not None and family in funnels:
            tables[family] = family.rolled_up(cube)
        else:
            table = family(sources, anchors)
            tables[family] = keep(table) if readers > 1 else table
    try:
        yield {name: chosen.finish(tables[chosen.family]) for name, chosen in wanted.items()}
    finally:
        for df in kept:
            df.unpersist()
