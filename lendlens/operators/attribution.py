"""Attribution of applications to user history and installs.

The relation behind these operators pairs an application with every history row of
its user, and those with every install of their attribution id, as long as neither
is dated an hour or more after what it is matched to. Pairs multiply within a busy
user or attribution id, so they are never formed: counts and measures travel as sums
over the range (see range_sums).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions import classify
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import filters
from lendlens.operators.aggregates import AMOUNTS, MEASURES, measure_terms
from lendlens.operators.range_sums import (
    COPIES,
    MICROS_PER_HOUR,
    summed_kind,
    sums_after,
    sums_before,
    tick_of,
    tick_sql,
)

SLACK = k.SLACK_HOURS * MICROS_PER_HOUR
AT = tick_sql("date_created")
USER, SOURCE = "user_id_ref", "attribution_id"

# Besides the six measures, joined rows and, for amounts, rows whose amount is unknown.
UNKNOWN = {name: f"{name}_unknown" for name in AMOUNTS}
CARRIED = (*MEASURES, *UNKNOWN.values(), "joined_rows")


def _earlier_matches(
    rows: DataFrame, earlier: DataFrame, key: str, name: str, weight: str | None = None
) -> DataFrame:
    """``rows`` that have a key and a date plus the (weighted) count of what they join to.

    Counts are found per key and instant; the adaptive skew join splits the rows that
    share one.
    """
    events = earlier.select(
        key,
        tick_of("date_created").alias("tick"),
        (F.lit(1).cast("long") if weight is None else F.col(weight)).alias(name),
    )
    ahead = rows.withColumn("tick", tick_of("date_created") + SLACK)
    points = ahead.select(key, "tick")
    sampled = [(earlier, key, AT), (rows, key, f"{AT} + {SLACK}")]
    counted = sums_before(events, points, key, [name], sampled)
    return ahead.join(counted, [key, "tick"]).select(*rows.columns, name)


def _left(rows: DataFrame, counted: DataFrame, key: str, name: str) -> DataFrame:
    """Add the rows that cannot match for want of a key or a date."""
    unmatchable = rows.filter(F.col(key).isNull() | F.col("date_created").isNull())
    return counted.unionByName(unmatchable.withColumn(name, F.lit(0).cast("long")))


def history_matches(apps: DataFrame, history: DataFrame) -> DataFrame:
    """Applications with ``history_matches``; a left join has max(matches, 1) rows."""
    counted = _earlier_matches(apps, history, USER, "history_matches")
    return _left(apps, counted, USER, "history_matches")


def install_matches(history: DataFrame, installs: DataFrame) -> DataFrame:
    """History rows with ``install_matches``, counted as in ``history_matches``."""
    counted = _earlier_matches(history, installs, SOURCE, "install_matches")
    return _left(history, counted, SOURCE, "install_matches")


def attributed_rows(
    apps: DataFrame, history: DataFrame, installs: DataFrame, anchors: PeriodAnchors
) -> DataFrame:
    """Applications with ``joined_rows``: history-install pairs, all within the lookback.

    Requiring a recent history row and a recent install makes both joins inner, so
    each input is cut to the lookback before anything is matched.
    """
    apps, history, installs = (
        filters.lookback_150d(table, anchors) for table in (apps, history, installs)
    )
    weighted = _earlier_matches(history, installs, SOURCE, "install_matches")
    weighted = weighted.filter("install_matches > 0")
    joined = _earlier_matches(apps, weighted, USER, "joined_rows", weight="install_matches")
    return joined.filter("joined_rows > 0")


def channel_measures(
    apps: DataFrame, history: DataFrame, installs: DataFrame, anchors: PeriodAnchors
) -> DataFrame:
    """The six measures by campaign type over the attributed applications.

    Applications push their measures to the history rows they join to, and those push
    the sums on to installs, so that each table's rows are carried once. Equal history
    rows, and equal installs, are one row with a count.
    """
    apps, history, installs = (
        filters.lookback_150d(table, anchors) for table in (apps, history, installs)
    )
    terms = measure_terms(
        anchors,
        "date",
        F.col("date_created"),
        F.col("disbursal_date"),
        F.lit(1).cast("long"),
        F.col("loan_amount"),
    )
    applied = apps.select(
        USER,
        F.expr(f"{AT} as tick"),
        *(term.alias(name) for name, term in terms.items()),
        F.lit(1).cast("long").alias("joined_rows"),
    )
    kinds = {field.name: summed_kind(field.dataType) for field in applied.schema}
    unknown = [f"cast({name} is null as bigint) as {flag}" for name, flag in UNKNOWN.items()]
    applied = applied.selectExpr("*", *unknown)
    visits = history.selectExpr(USER, SOURCE, f"{AT} as visited", f"{AT} - {SLACK} as tick")
    sampled = [(apps, USER, AT), (history, USER, f"{AT} - {SLACK}")]
    visited = (
        sums_after(applied, visits, USER, CARRIED, sampled)
        .where("joined_rows > 0")
        .selectExpr(
            SOURCE, "visited as tick", *(f"{name} * {COPIES} as {name}" for name in CARRIED)
        )
    )
    installed = installs.select(
        SOURCE, classify.campaign_type().alias("campaign_type"), F.expr(f"{AT} - {SLACK} as tick")
    )
    sampled = [(history, SOURCE, AT), (installs, SOURCE, f"{AT} - {SLACK}")]
    totals = (
        sums_after(visited, installed, SOURCE, CARRIED, sampled)
        .where("joined_rows > 0")
        .groupBy("campaign_type")
        .agg(*(F.expr(f"sum({name} * {COPIES}) as {name}") for name in CARRIED))
    )
    # A sum of nothing but unknown amounts is unknown, not zero; amounts have the type of
    # their sum over applications.
    known = {
        name: f"case when {flag} < joined_rows then {name} end" for name, flag in UNKNOWN.items()
    }
    return totals.selectExpr(
        "campaign_type",
        *(f"cast({known.get(name, name)} as {kinds[name]}) as {name}" for name in MEASURES),
    )
