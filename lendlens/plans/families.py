"""The relation behind each group of reports, before its filter and ordering."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions import classify, metrics
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import attribution, by_application, filters, tags
from lendlens.operators.aggregates import MEASURES, STARTS, period_pivot
from lendlens.operators.projections import normalize_timestamps
from lendlens.plans.day_cube import LABELS
from lendlens.sources.tables import Sources


def _pivot(sources: Sources, anchors: PeriodAnchors, labels: Iterable[str]) -> DataFrame:
    """The six measures of the lookback by the given labels, from closed days where kept."""
    if sources.day_cube is not None:
        return sources.day_cube.pivot(sources.loan_application, anchors, labels)
    recent = filters.lookback_150d(sources.loan_application, anchors)
    labelled = normalize_timestamps(recent).select(
        "date_created",
        "disbursal_date",
        "loan_amount",
        *(LABELS[name]().alias(name) for name in labels),
    )
    return period_pivot(labelled, list(labels), anchors)


def funnel_cube(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    """The measures by every label at once: a small table that any funnel rolls up."""
    return _pivot(sources, anchors, LABELS)


@dataclass(frozen=True)
class Funnel:
    """Measures and metrics by programme and, for most, a second label."""

    programme: str
    second: str | None = None

    @property
    def labels(self) -> list[str]:
        return [self.programme] if self.second is None else [self.programme, self.second]

    def __call__(self, sources: Sources, anchors: PeriodAnchors) -> DataFrame:
        return self._finished(_pivot(sources, anchors, self.labels))

    def rolled_up(self, cube: DataFrame) -> DataFrame:
        sums = (F.expr(f"sum({name}) as {name}") for name in MEASURES)
        return self._finished(cube.groupBy(*self.labels).agg(*sums))

    def _finished(self, pivot: DataFrame) -> DataFrame:
        named = pivot.withColumnRenamed(self.programme, "programme")
        return metrics.add_funnel_metrics(named)


month_over_month = Funnel("single_app_programme")
partners = Funnel("two_app_programme", "partner_bucket")
platforms = Funnel("two_app_programme", "platform")
ticket_sizes = Funnel("two_app_programme", "ticket_size")


def channels(sources: Sources, anchors: PeriodAnchors, programme: str = k.MVL_NEW) -> DataFrame:
    """One programme by acquisition channel, counting every attributed pair."""
    apps = sources.loan_application.filter(classify.programme_single_app() == programme)
    measures = attribution.channel_measures(
        apps, sources.app_user_history, sources.install_event, anchors
    )
    return metrics.add_funnel_metrics(measures.select(F.lit(programme).alias("programme"), "*"))


def repeat_customers(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    """By programme and tag bucket; an application counts once per pair of its tags."""
    apps = normalize_timestamps(filters.either_date_60d(sources.loan_application, anchors))
    counts = by_application.counts_of(sources, anchors)
    labelled = tags.left_two_tag_flags(apps, counts).select(
        "date_created",
        "disbursal_date",
        "loan_amount",
        "copies",
        classify.programme_repeat_only().alias("programme"),
        classify.repeat_bucket_flags().alias("repeat_bucket"),
    )
    pivot = period_pivot(labelled, ["programme", "repeat_bucket"], anchors, copies="copies")
    return metrics.add_funnel_metrics(pivot)


def repeat_rows(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    """Recently created plus recently disbursed applications by tag bucket.

    ``copies`` counts the branches an application is in times its tags in the bucket.
    """
    apps = tags.recent_branches(sources.loan_application, anchors)
    counts = by_application.counts_of(sources, anchors)
    return tags.left_tag_bucket(apps, counts).select(
        "date_created",
        "disbursal_date",
        "loan_amount",
        (F.col("branches") * F.col("copies")).alias("copies"),
        classify.programme_repeat_only().alias("programme"),
        classify.repeat_bucket_coalesce().alias("repeat_bucket"),
    )


def repeat_starts(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    pivot = period_pivot(
        repeat_rows(sources, anchors),
        ["programme", "repeat_bucket"],
        anchors,
        grain="date",
        copies="copies",
        measures=STARTS,
    )
    return pivot.withColumn("change_in_starts_pct", metrics.change_in_starts_pct())


def volume_projection(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    """Disbursed volume by programme, with the running month projected to its end."""
    apps = filters.among(
        sources.loan_application, "loan_product_id", [*k.NEW_PRODUCTS, k.REPEAT_PRODUCT]
    )
    labelled = filters.disbursed_since_last_month(apps, anchors).select(
        "disbursal_date", "loan_amount", classify.programme_non_null().alias("programme")
    )
    return labelled.groupBy("programme").agg(
        metrics.prev_month_mtd(anchors).alias("prev_month_mtd"),
        metrics.current_month_mtd(anchors).alias("current_month_mtd"),
        metrics.current_month_projection(anchors).alias("current_month_total"),
        metrics.last_month_total(anchors).alias("last_month_total"),
    )
