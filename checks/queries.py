"""One query per operator and report, over the sample relations of a data directory.

Each function takes the sources and the anchors; its name is its key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens import constants as k
from lendlens.functions import classify, metrics
from lendlens.functions.anchors import INSTANT, PeriodAnchors, parsed_instant
from lendlens.operators import aggregates, attribution, by_application, filters, projections, tags
from lendlens.operators.results import ordered, union_all
from lendlens.plans import families
from lendlens.plans.day_cube import DayCube
from lendlens.plans.reports import REPORTS, report
from lendlens.sources.sample import sample
from lendlens.sources.schemas import SCHEMAS
from lendlens.sources.tables import Sources, params_row

AS_OF = "2000-03-15 13:30:00"

Query = Callable[[Sources, PeriodAnchors], DataFrame]
QUERIES: dict[str, Query] = {}


def query(made: Query) -> Query:
    QUERIES[made.__name__] = made
    return made


def plain(df: DataFrame) -> DataFrame:
    """Types that compare alike in both engines: amounts as doubles, times as text."""

    def cell(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = value.cast("string")
        return value.alias(field.name)

    return df.select(*map(cell, df.schema))


def registry(as_of: str = AS_OF) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(made: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(made(sample(spark, sf_dir), PeriodAnchors.of(as_of)))

    def of_report(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(report(sample(spark, sf_dir), name, as_of))

    made = {name: bound(fn) for name, fn in QUERIES.items()}
    return made | {name: of_report(name) for name in REPORTS}


def counted(df: DataFrame, *keys: str | Column, name: str = "applications") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def labelled(s: Sources, **labels: Column) -> DataFrame:
    return s.loan_application.withColumns(labels)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that executors share; a temporary one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="cube-")
    return f"{shared.rstrip('/')}/cube-{uuid.uuid4().hex}"


# Sources and sinks.


@query
def src_loan_application(s, a):
    return s.loan_application.select(*SCHEMAS["loan_application"])


@query
def src_application_tags(s, a):
    return s.loan_application_metadata


@query
def src_user_history(s, a):
    return s.app_user_history.select(*SCHEMAS["app_user_history"])


@query
def src_install_event(s, a):
    return s.install_event.select(*SCHEMAS["install_event"])


@query
def src_params_row(s, a):
    latest = s.loan_application.agg(F.max("date_created").alias("as_of"))
    return params_row(latest, "as_of")


@query
def sink_result(s, a):
    return ordered(families.volume_projection(s, a), "programme")


# Anchors, with every application's creation time as the "as of" instant.


def anchor_counts(s: Sources, **anchors: Callable[[PeriodAnchors], Column]) -> DataFrame:
    per_row = PeriodAnchors.of(F.col("date_created"))
    return counted(s.loan_application, *(of(per_row).alias(n) for n, of in anchors.items()))


@query
def anchor_now(s, a):
    return anchor_counts(s, now_ts=lambda p: p.now)


@query
def anchor_today(s, a):
    return anchor_counts(s, today=lambda p: p.today)


@query
def anchor_current_month_start(s, a):
    return anchor_counts(
        s, as_instant=lambda p: p.current_month_start, as_date=lambda p: p.current_month_first
    )


@query
def anchor_last_month_start(s, a):
    return anchor_counts(
        s, as_instant=lambda p: p.last_month_start, as_date=lambda p: p.last_month_first
    )


@query
def anchor_same_day_last_month(s, a):
    return anchor_counts(
        s,
        as_instant=lambda p: p.same_day_last_month,
        as_date=lambda p: p.same_day_last_month_date,
    )


@query
def anchor_last_month_end(s, a):
    return anchor_counts(s, last_month_end=lambda p: p.last_month_end)


@query
def anchor_last_day_of_month(s, a):
    return anchor_counts(
        s, this_month=lambda p: p.last_day_of_month, last_month=lambda p: p.last_day_of_last_month
    )


@query
def anchor_yesterday(s, a):
    return anchor_counts(s, yesterday=lambda p: p.yesterday)


# Projections.


@query
def proj_columns(s, a):
    return s.loan_application.select(
        F.col("id").alias("application_id"), "loan_product_id", "loan_amount"
    )


@query
def proj_normalize_timestamps(s, a):
    return projections.normalize_timestamps(s.loan_application).select(
        "id", "date_created", "disbursal_date"
    )


@query
def proj_to_date(s, a):
    return projections.to_dates(s.loan_application).select("id", "created_date", "disbursal_date")


@query
def proj_month_bucket(s, a):
    return counted(
        projections.month_buckets(s.loan_application), "created_month", "disbursed_month"
    )


@query
def proj_star_extend(s, a):
    return families.month_over_month(s, a)


@query
def proj_explicit_final(s, a):
    return families.platforms(s, a).select(
        "programme", "platform", *aggregates.MEASURES, *metrics.funnel_metrics()
    )


@query
def proj_star_output(s, a):
    return families.partners(s, a).select("*")


@query
def proj_metric_pair(s, a):
    return projections.metric_pair(
        families.repeat_customers(s, a), "repeat_bucket", "last_conversion", "current_conversion"
    )


# Classifiers.


def class_counts(s: Sources, label: Column, *inputs: str) -> DataFrame:
    return counted(s.loan_application, *inputs, label.alias("label"))


@query
def cls_programme_single_app(s, a):
    return class_counts(s, classify.programme_single_app(), "loan_product_id", "app_name")


@query
def cls_programme_two_app(s, a):
    return class_counts(s, classify.programme_two_app(), "loan_product_id", "app_name")


@query
def cls_programme_repeat_only(s, a):
    return class_counts(s, classify.programme_repeat_only(), "loan_product_id", "app_name")


@query
def cls_programme_non_null(s, a):
    return class_counts(s, classify.programme_non_null(), "loan_product_id", "app_name")


@query
def cls_platform(s, a):
    return class_counts(s, classify.platform(), "app_name")


@query
def cls_partner_bucket(s, a):
    return class_counts(s, classify.partner_bucket(), "app_name")


@query
def cls_ticket_size(s, a):
    return class_counts(s, classify.ticket_size(), "loan_tenure")


@query
def cls_tag_bucket(s, a):
    return counted(
        s.loan_application_metadata, "tag_name", classify.tag_bucket().alias("label"), name="tags"
    )


@query
def cls_repeat_bucket_flags(s, a):
    joined = tags.left_two_tag_flags(
        s.loan_application, tags.tag_counts(s.loan_application_metadata, a)
    )
    return counted(
        joined,
        "loan_product_id",
        "app_name",
        F.col("lowngrow_id").isNotNull().cast("int").alias("lowngrow"),
        F.col("starter_id").isNotNull().cast("int").alias("starter"),
        classify.repeat_bucket_flags().alias("label"),
    )


@query
def cls_repeat_bucket_coalesce(s, a):
    joined = tags.left_tag_bucket(
        s.loan_application, tags.tag_counts(s.loan_application_metadata, a)
    )
    return counted(
        joined,
        "loan_product_id",
        "app_name",
        "tag_bucket",
        classify.repeat_bucket_coalesce().alias("label"),
    )


@query
def cls_campaign_type(s, a):
    return counted(
        s.install_event, "campaign_type", classify.campaign_type().alias("label"), name="installs"
    )


# Filters.


@query
def flt_lookback_150d(s, a):
    return filters.lookback_150d(s.loan_application, a).select("id", "date_created")


@query
def flt_lookback_150d_multi(s, a):
    def kept(name: str, df: DataFrame) -> DataFrame:
        recent = filters.lookback_150d(df, a)
        return recent.agg(
            F.lit(name).alias("relation"),
            F.count(F.lit(1)).alias("kept"),
            F.min("date_created").alias("earliest"),
        )

    return (
        kept("applications", s.loan_application)
        .unionByName(kept("history", s.app_user_history))
        .unionByName(kept("installs", s.install_event))
    )


@query
def flt_tag_lookback_60d(s, a):
    return filters.lookback_60d(s.loan_application_metadata, a)


@query
def flt_either_date_60d(s, a):
    return filters.either_date_60d(s.loan_application, a).select(
        "id", "date_created", "disbursal_date"
    )


@query
def flt_created_60d(s, a):
    return filters.lookback_60d(s.loan_application, a).select("id", "date_created")


@query
def flt_disbursed_60d(s, a):
    return filters.disbursed_60d(s.loan_application, a).select("id", "disbursal_date")


@query
def flt_disbursed_since_last_month(s, a):
    return filters.disbursed_since_last_month(s.loan_application, a).select("id", "disbursal_date")


@query
def flt_in_list(s, a):
    kept = filters.among(s.loan_application, "loan_product_id", [*k.NEW_PRODUCTS, k.REPEAT_PRODUCT])
    return kept.select("id", "loan_product_id")


@query
def flt_equals(s, a):
    df = labelled(s, programme=classify.programme_two_app())
    return df.filter(F.col("programme") == k.TOPUP).select("id", "programme")


@query
def flt_not_like(s, a):
    df = labelled(s, programme=classify.programme_single_app())
    return filters.not_like(df, "programme", "Others").select("id", "programme")


@query
def flt_like_any(s, a):
    parts = k.PARTNER_GROUPS["BlueChips"]
    kept = s.loan_application.filter(classify.contains_any(F.col("app_name"), parts))
    return kept.select("id", "app_name")


@query
def flt_null_tests(s, a):
    kept = s.loan_application.filter(
        F.col("loan_product_id").isNull() & F.col("disbursal_date").isNotNull()
    )
    return kept.select("id", "disbursal_date")


@query
def flt_not_equal_3vl(s, a):
    return s.loan_application.filter(F.col("app_name") != k.APP_TOPUP).select("id", "app_name")


@query
def flt_between(s, a):
    kept = a.last_period("date").holds(F.to_date("date_created"))
    return s.loan_application.filter(kept).select("id", "date_created")


@query
def flt_range_closed(s, a):
    kept = a.last_period("ts").holds(F.col("date_created"))
    return s.loan_application.filter(kept).select("id", "date_created")


@query
def flt_range_half_open(s, a):
    day = F.to_date("disbursal_date")
    kept = (day >= a.last_month_first) & (day < a.same_day_last_month_date)
    return s.loan_application.filter(kept).select("id", "disbursal_date")


@query
def flt_post_aggregate(s, a):
    df = labelled(
        s, programme=classify.programme_two_app(), partner_bucket=classify.partner_bucket()
    )
    return filters.among(counted(df, "programme", "partner_bucket"), "programme", [k.DP_NEW])


# Joins.


def join_counts(joined: DataFrame, copies: Column, *keys: str | Column) -> DataFrame:
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("applications"), F.sum(copies).alias("joined_rows")
    )


@query
def join_left_tag_flag(s, a):
    joined = tags.left_tag_flag(
        s.loan_application, tags.tag_counts(s.loan_application_metadata, a)
    )
    tagged = F.col("lowngrow_id").isNotNull().cast("int").alias("lowngrow")
    return join_counts(joined, F.col("copies"), "loan_product_id", tagged)


@query
def join_left_two_tag_flags(s, a):
    joined = tags.left_two_tag_flags(
        s.loan_application, tags.tag_counts(s.loan_application_metadata, a)
    )
    return join_counts(
        joined,
        F.col("copies"),
        "loan_product_id",
        F.col("lowngrow_id").isNotNull().cast("int").alias("lowngrow"),
        F.col("starter_id").isNotNull().cast("int").alias("starter"),
    )


@query
def join_left_tag_bucket(s, a):
    joined = tags.left_tag_bucket(
        s.loan_application, tags.tag_counts(s.loan_application_metadata, a)
    )
    return join_counts(joined, F.col("copies"), "loan_product_id", "tag_bucket")


def left_join_rows(matches: str) -> Column:
    return F.greatest(F.col(matches), F.lit(1).cast("long"))


@query
def join_bucketed_tags(s, a):
    """Both tag flags by joining stored buckets of applications."""
    spark = s.loan_application.sparkSession
    folder, name = shared_folder(spark), f"stored_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    apps, days = f"{name}_apps", f"{name}_tags"
    by_application.store_applications(s.loan_application, apps, buckets, f"{folder}/apps")
    by_application.store_tags(s.loan_application_metadata, days, buckets, f"{folder}/tags")
    counts = by_application.counts_of_days(spark.table(days), a)
    joined = tags.left_two_tag_flags(spark.table(apps), counts)
    return join_counts(
        joined,
        F.col("copies"),
        "loan_product_id",
        F.col("lowngrow_id").isNotNull().cast("int").alias("lowngrow"),
        F.col("starter_id").isNotNull().cast("int").alias("starter"),
    )


@query
def join_user_history_range(s, a):
    matched = attribution.history_matches(s.loan_application, s.app_user_history)
    return join_counts(
        matched,
        left_join_rows("history_matches"),
        "loan_product_id",
        (F.col("history_matches") > 0).cast("int").alias("matched"),
    )


@query
def join_install_range(s, a):
    matched = attribution.install_matches(s.app_user_history, s.install_event)
    return join_counts(
        matched,
        left_join_rows("install_matches"),
        F.col("attribution_id").alias("source"),
        (F.col("install_matches") > 0).cast("int").alias("matched"),
    )


@query
def join_null_rejecting_where(s, a):
    rows = attribution.attributed_rows(
        s.loan_application, s.app_user_history, s.install_event, a
    )
    programme = classify.programme_single_app().alias("programme")
    return join_counts(rows, F.col("joined_rows"), programme)


@query
def join_spread_keys(s, a):
    """The same by application."""
    rows = attribution.attributed_rows(
        s.loan_application, s.app_user_history, s.install_event, a
    )
    return join_counts(rows, F.col("joined_rows"), "id")


@query
def join_cross_params(s, a):
    joined = projections.with_params(s.loan_application, a)
    started = F.col("date_created").between(F.col("current_month_start"), F.col("now_ts"))
    return joined.groupBy(*a.instants()).agg(
        F.count(F.lit(1)).alias("applications"), F.count_if(started).alias("current_starts")
    )


# Aggregations.


def recent(s: Sources, a: PeriodAnchors, **labels: Column) -> DataFrame:
    return filters.lookback_150d(s.loan_application, a).withColumns(labels)


@query
def agg_pre_grain_ts(s, a):
    df = recent(s, a, programme=classify.programme_single_app())
    return aggregates.pre_grain(df, ["programme"])


@query
def agg_pre_grain_ts_no_product(s, a):
    df = recent(s, a, programme=classify.programme_two_app(), ticket_size=classify.ticket_size())
    return aggregates.pre_grain(df, ["programme", "ticket_size"], with_product=False)


@query
def agg_pre_grain_date(s, a):
    df = recent(s, a, programme=classify.programme_single_app(), platform=classify.platform())
    return aggregates.pre_grain(df, ["programme", "platform"], grain="date")


@query
def agg_count_rows(s, a):
    return counted(labelled(s, programme=classify.programme_two_app()), "programme")


@query
def agg_sum_if_disbursed(s, a):
    df = labelled(s, programme=classify.programme_two_app())
    amount = aggregates.disbursed_amount(F.col("disbursal_date"), F.col("loan_amount"))
    return df.groupBy("programme").agg(amount.alias("amount"))


@query
def agg_period_pivot_ts(s, a):
    df = recent(s, a, programme=classify.programme_single_app())
    return aggregates.period_pivot(df, ["programme"], a)


@query
def agg_period_pivot_date(s, a):
    df = recent(s, a, programme=classify.programme_single_app())
    return aggregates.period_pivot(df, ["programme"], a, grain="date")


@query
def agg_period_pivot_starts_only(s, a):
    df = labelled(s, programme=classify.programme_repeat_only())
    return aggregates.period_pivot(
        df, ["programme"], a, grain="date", measures=aggregates.STARTS
    )


@query
def agg_two_level(s, a):
    df = recent(
        s, a, programme=classify.programme_two_app(), partner_bucket=classify.partner_bucket()
    )
    return aggregates.two_level(df, ["programme", "partner_bucket"], a)


@query
def agg_day_cube(s, a):
    """Partners from closed days, the last week of them closed later, and the running day."""
    apps = s.loan_application
    spark = apps.sparkSession
    today = parsed_instant(AS_OF).date()
    cube = DayCube(spark, shared_folder(spark))
    cube.close(apps, today - timedelta(days=k.LOOKBACK_DAYS), today - timedelta(days=8))
    cube.close(apps, today - timedelta(days=7), today - timedelta(days=1))
    return families.partners(s.with_day_cube(cube), a)


@query
def agg_single_stage_alias_key(s, a):
    return families.volume_projection(s, a)


@query
def agg_group_by_ordinal(s, a):
    df = labelled(s, programme=classify.programme_two_app(), platform=classify.platform())
    return counted(df, "programme", "platform")


@query
def agg_null_group(s, a):
    return counted(labelled(s, ticket_size=classify.ticket_size()), "ticket_size")


# Set operations and ordering.


@query
def set_union_all(s, a):
    apps = labelled(s, programme=classify.programme_repeat_only())
    both = union_all(filters.lookback_60d(apps, a), filters.disbursed_60d(apps, a))
    return counted(both, "programme", name="rows")


@query
def sort_single_key(s, a):
    df = labelled(s, programme=classify.programme_single_app())
    return ordered(counted(df, "programme"), "programme")


@query
def sort_two_keys(s, a):
    df = labelled(
        s, programme=classify.programme_two_app(), partner_bucket=classify.partner_bucket()
    )
    return ordered(counted(df, "programme", "partner_bucket"), "programme", "partner_bucket")


@query
def sort_nulls_first(s, a):
    df = labelled(s, ticket_size=classify.ticket_size())
    return ordered(counted(df, "ticket_size"), "ticket_size")


# Scalar functions.


def values(s: Sources, value: Column) -> DataFrame:
    return s.loan_application.select("id", value.alias("value"))


def value_counts(s: Sources, value: Column) -> DataFrame:
    return counted(s.loan_application, value.alias("value"))


@query
def fn_current_timestamp(s, a):
    clock = PeriodAnchors.of()
    return value_counts(s, (F.col("date_created") <= clock.now).cast("int"))


@query
def fn_current_date(s, a):
    clock = PeriodAnchors.of()
    return value_counts(s, (F.to_date("date_created") <= clock.today).cast("int"))


@query
def fn_timestamp_trunc_month(s, a):
    return value_counts(s, projections.month_of("disbursal_date"))


@query
def fn_date_trunc_month(s, a):
    return value_counts(s, F.trunc(F.to_date("date_created"), "MM"))


@query
def fn_timestamp_cast(s, a):
    return values(s, F.to_date("date_created").cast(INSTANT))


@query
def fn_date_cast(s, a):
    return values(s, F.to_date("disbursal_date"))


@query
def fn_date_sub_month(s, a):
    return values(s, F.add_months(F.to_date("disbursal_date"), -1))


@query
def fn_date_sub_day(s, a):
    return values(s, F.date_sub(F.to_date("date_created"), k.RECENT_DAYS))


@query
def fn_timestamp_sub(s, a):
    return values(s, PeriodAnchors.of(F.col("date_created")).instant_days_ago(k.LOOKBACK_DAYS))


@query
def fn_interval_arith(s, a):
    return values(s, F.col("date_created") - F.make_dt_interval(hours=F.lit(k.SLACK_HOURS)))


@query
def fn_last_day(s, a):
    return value_counts(s, F.last_day("date_created"))


@query
def fn_extract_day(s, a):
    return value_counts(s, F.dayofmonth("date_created"))


@query
def fn_round(s, a):
    return values(s, F.round(F.col("loan_amount").cast("double") / 7, 2))


@query
def fn_nullif(s, a):
    return value_counts(s, F.nullif(F.col("loan_tenure"), F.lit(k.MICRO_TENURE)))


@query
def fn_coalesce(s, a):
    return value_counts(s, F.coalesce(F.col("app_name"), F.col("loan_product_id")))


@query
def fn_upper(s, a):
    return counted(s.loan_application_metadata, F.upper("tag_name").alias("value"), name="tags")


@query
def fn_lower(s, a):
    return counted(s.install_event, F.lower("campaign_type").alias("value"), name="installs")


@query
def fn_like(s, a):
    return value_counts(s, F.col("app_name").contains(".pb.").cast("int"))


@query
def fn_case_searched(s, a):
    long_or_short = classify.case_of(
        [(F.col("loan_tenure") > k.MICRO_TENURE, "long"), (F.col("loan_tenure") > 3, "medium")],
        "short or unknown",
    )
    return value_counts(s, long_or_short)


@query
def fn_arith(s, a):
    share = F.col("loan_amount").cast("double") / F.col("loan_tenure") * 100
    return values(s, share - F.col("loan_amount").cast("double"))


# Metrics.


def metric(s: Sources, a: PeriodAnchors, **wanted: Column) -> DataFrame:
    df = recent(s, a, programme=classify.programme_two_app(), platform=classify.platform())
    pivot = aggregates.period_pivot(df, ["programme", "platform"], a)
    return pivot.select("programme", "platform", *(v.alias(n) for n, v in wanted.items()))


def volume(s: Sources, a: PeriodAnchors, **wanted: Column) -> DataFrame:
    df = labelled(s, programme=classify.programme_non_null())
    return df.groupBy("programme").agg(*(v.alias(n) for n, v in wanted.items()))


@query
def met_change_in_starts_pct(s, a):
    return metric(s, a, change_in_starts_pct=metrics.change_in_starts_pct())


@query
def met_last_conversion(s, a):
    return metric(s, a, last_conversion=metrics.conversion("last"))


@query
def met_current_conversion(s, a):
    return metric(s, a, current_conversion=metrics.conversion("current"))


@query
def met_change_in_conversion_pct(s, a):
    return metric(s, a, change_in_conversion_pct=metrics.change_in_conversion_pct())


@query
def met_last_ats(s, a):
    return metric(s, a, last_ats=metrics.ats("last"))


@query
def met_current_ats(s, a):
    return metric(s, a, current_ats=metrics.ats("current"))


@query
def met_change_in_ats_pct(s, a):
    return metric(s, a, change_in_ats_pct=metrics.change_in_ats_pct())


@query
def met_prev_month_mtd(s, a):
    return volume(s, a, prev_month_mtd=metrics.prev_month_mtd(a))


@query
def met_current_month_mtd(s, a):
    return volume(s, a, current_month_mtd=metrics.current_month_mtd(a))


@query
def met_current_month_projection(s, a):
    return volume(s, a, current_month_total=metrics.current_month_projection(a))


@query
def met_last_month_total(s, a):
    return volume(s, a, last_month_total=metrics.last_month_total(a))
