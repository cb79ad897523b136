"""The same results as SQL for a second engine, over the original test tables.

Written apart from the library: anchors are date literals worked out here, joins are
plain joins, and the sample relations are derived again in SQL.
"""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from lendlens import constants as k

VIEWS = {
    "loan_application": f"""
        SELECT o_orderkey AS id, o_custkey AS user_id_ref,
          CASE WHEN digit <= 2 THEN '1' WHEN digit = 3 THEN '5'
               WHEN digit BETWEEN 5 AND 8 THEN '6' WHEN digit = 9 THEN '2' END AS loan_product_id,
          CASE WHEN slot <= 4 THEN '{k.APP_MAIN}' WHEN slot <= 6 THEN '{k.APP_IOS}'
               WHEN slot <= 8 THEN '{k.APP_TOPUP}' WHEN slot = 9 THEN 'com.supermoney.app'
               WHEN slot = 10 THEN 'com.agg.pb.stpl.web' WHEN slot = 11 THEN 'com.fintifi.app'
               WHEN slot = 12 THEN 'com.agg.fb.web' WHEN slot = 13 THEN 'com.phonepe.app'
               WHEN slot = 14 THEN 'com.other.ios' END AS app_name,
          made AS date_created,
          CASE WHEN o_orderstatus = 'P' THEN NULL
               WHEN o_orderkey % 2 = 0 THEN made + INTERVAL 9 DAY
               ELSE made + INTERVAL 33 DAY END AS disbursal_date,
          CASE WHEN o_orderkey % 29 = 0 THEN NULL
               ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS loan_amount,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL
               ELSE CAST(3 + o_orderkey % 8 AS INTEGER) END AS loan_tenure
        FROM (SELECT *, o_orderkey % 10 AS digit, (o_orderkey // 10) % 16 AS slot,
                o_orderdate + (o_orderkey * 7 % 24) * INTERVAL 1 HOUR
                            + (o_orderkey * 37 % 60) * INTERVAL 1 MINUTE AS made
              FROM orders)""",
    "loan_application_metadata": """
        SELECT l_orderkey AS loan_application_id_ref,
          CASE l_partkey % 9 WHEN 0 THEN 'low_and_grow' WHEN 1 THEN 'PremiumLowNGrowRepeat'
               WHEN 2 THEN 'LOW_AND_GROW_PC' WHEN 3 THEN 'REGULARLOWNGROWREPEAT'
               WHEN 4 THEN 'STARTER_REPEAT' WHEN 5 THEN 'starter_relaxed_bureau'
               ELSE 'OTHER_TAG' END AS tag_name,
          l_shipdate AS date_created
        FROM lineitem""",
    "app_user_history": """
        SELECT o_custkey AS user_id_ref,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'own-' || o_orderkey
               ELSE 'att-' || (o_custkey // 10) END AS attribution_id,
          o_orderdate + (o_orderkey * 5 % 24) * INTERVAL 1 HOUR AS date_created
        FROM orders""",
    "install_event": """
        SELECT 'att-' || (o_custkey // 10) AS attribution_id,
          CASE o_orderkey % 5 WHEN 0 THEN 'UAC' WHEN 1 THEN 'Facebook' WHEN 2 THEN 'affiliate'
               WHEN 4 THEN 'REFERRAL' END AS campaign_type,
          o_orderdate + (o_orderkey * 11 % 24) * INTERVAL 1 HOUR AS date_created
        FROM orders""",
}


def listed(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def like_any(column: str, parts) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{part}%'" for part in parts) + ")"


def programme(own_apps, unknown_is_new: bool = True) -> str:
    new = f"coalesce(loan_product_id IN {listed(k.NEW_PRODUCTS)}, {str(unknown_is_new).lower()})"
    own = f"app_name IN {listed(own_apps)}"
    return f"""CASE WHEN {new} THEN CASE WHEN {own} THEN '{k.MVL_NEW}' ELSE '{k.DP_NEW}' END
        WHEN loan_product_id = '6' THEN
          CASE WHEN {own} THEN '{k.MVL_REPEAT}'
               WHEN app_name = '{k.APP_TOPUP}' THEN '{k.TOPUP}' ELSE '{k.DP_REPEAT}' END
        ELSE '{k.OTHERS}' END"""


SINGLE = programme([k.APP_MAIN])
TWO = programme([k.APP_MAIN, k.APP_IOS])
NON_NULL = programme([k.APP_MAIN], unknown_is_new=False)
REPEAT_ONLY = f"""CASE WHEN loan_product_id IS DISTINCT FROM '6' THEN '{k.OTHERS}'
    WHEN app_name IN {listed([k.APP_MAIN, k.APP_IOS])} THEN '{k.MVL_REPEAT}'
    ELSE '{k.DP_REPEAT}' END"""
PLATFORM = "CASE WHEN app_name LIKE '%.ios%' THEN 'iOS' ELSE 'Android' END"
PARTNER = (
    "CASE "
    + " ".join(f"WHEN {like_any('app_name', v)} THEN '{n}'" for n, v in k.PARTNER_GROUPS.items())
    + f" ELSE '{k.PARTNER_DEFAULT}' END"
)
TICKET = """CASE WHEN loan_tenure IS NULL THEN NULL WHEN loan_tenure > 6 THEN 'Regular'
    WHEN loan_tenure < 6 THEN 'Mini' ELSE 'Micro' END"""
TAG = f"""CASE WHEN upper(tag_name) IN {listed(k.LOW_AND_GROW_TAGS)} THEN 'LowNGrow'
    WHEN upper(tag_name) IN {listed(k.STARTER_TAGS)} THEN 'Starter' END"""
UNTAGGED = f"""CASE WHEN loan_product_id = '6' AND app_name <> '{k.APP_TOPUP}'
    THEN 'Regular' ELSE 'Others' END"""
FLAGS = f"""CASE WHEN {UNTAGGED} = 'Others' THEN 'Others' WHEN lowngrow = 1 THEN 'LowNGrow'
    WHEN starter = 1 THEN 'Starter' ELSE 'Regular' END"""


def rounded(value: str, digits: int = 2) -> str:
    """Half away from zero on the shortest decimal text of a double."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"


def ratio(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0))"


def change(last: str, current: str) -> str:
    return rounded(f"(({current} - {last}) / nullif({last}, 0) * 100)")


LAST_CONVERSION = ratio("last_disbursed", "last_starts")
CURRENT_CONVERSION = ratio("current_disbursed", "current_starts")
LAST_ATS = ratio("last_disbursed_amt", "last_disbursed")
CURRENT_ATS = ratio("current_disbursed_amt", "current_disbursed")
METRICS = {
    "change_in_starts_pct": change("CAST(last_starts AS DOUBLE)", "CAST(current_starts AS DOUBLE)"),
    "last_conversion": rounded(LAST_CONVERSION, 4),
    "current_conversion": rounded(CURRENT_CONVERSION, 4),
    "change_in_conversion_pct": change(LAST_CONVERSION, CURRENT_CONVERSION),
    "last_ats": rounded(LAST_ATS),
    "current_ats": rounded(CURRENT_ATS),
    "change_in_ats_pct": change(LAST_ATS, CURRENT_ATS),
}
ALL_METRICS = ", ".join(f"{value} AS {name}" for name, value in METRICS.items())
MEASURES = """last_starts, current_starts, last_disbursed, current_disbursed,
    CAST(last_disbursed_amt AS DOUBLE) AS last_disbursed_amt,
    CAST(current_disbursed_amt AS DOUBLE) AS current_disbursed_amt"""


class Calendar:
    """The anchors as SQL literals."""

    def __init__(self, as_of: str):
        now = datetime.fromisoformat(as_of)
        today = now.date()
        first = today.replace(day=1)
        last_end = first - timedelta(days=1)
        same_day = last_end.replace(day=min(today.day, last_end.day))
        month_length = calendar.monthrange(today.year, today.month)[1]

        def day(value: date) -> str:
            return f"DATE '{value}'"

        def instant(value: date | datetime) -> str:
            return f"TIMESTAMP '{value}'"

        self.now = instant(now)
        self.today = day(today)
        self.first, self.first_ts = day(first), instant(first)
        self.last_first = day(last_end.replace(day=1))
        self.last_first_ts = instant(last_end.replace(day=1))
        self.same_day, self.same_day_ts = day(same_day), instant(same_day)
        self.last_end = day(last_end)
        self.last_end_ts = instant(
            datetime.combine(first, datetime.min.time()) - timedelta(seconds=1)
        )
        self.days_150 = instant(now - timedelta(days=150))
        self.days_60 = day(today - timedelta(days=60))
        self.run_rate = f"({month_length}.0::DOUBLE / {(today - timedelta(days=1)).day})"

    def pivot(self, grain: str) -> str:
        if grain == "ts":
            made, paid = "date_created", "disbursal_date"
            last = f"BETWEEN {self.last_first_ts} AND {self.same_day_ts}"
            current = f"BETWEEN {self.first_ts} AND {self.now}"
        else:
            made, paid = "CAST(date_created AS DATE)", "CAST(disbursal_date AS DATE)"
            last = f"BETWEEN {self.last_first} AND {self.same_day}"
            current = f"BETWEEN {self.first} AND {self.today}"
        return f"""
            count(*) FILTER ({made} {last}) AS last_starts,
            count(*) FILTER ({made} {current}) AS current_starts,
            count(*) FILTER ({paid} {last}) AS last_disbursed,
            count(*) FILTER ({paid} {current}) AS current_disbursed,
            sum(CASE WHEN {paid} {last} THEN loan_amount ELSE 0 END) AS last_disbursed_amt,
            sum(CASE WHEN {paid} {current} THEN loan_amount ELSE 0 END) AS current_disbursed_amt"""


def with_views(body: str) -> str:
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    return f"WITH {views}\n{body}"


def build(as_of: str) -> dict[str, str]:
    c = Calendar(as_of)
    apps = "loan_application"
    recent = f"(SELECT * FROM loan_application WHERE date_created >= {c.days_150})"
    sql: dict[str, str] = {}

    # Sources and sinks.
    sql["src_loan_application"] = f"""SELECT id, user_id_ref, loan_product_id, app_name,
        CAST(date_created AS VARCHAR) AS date_created,
        CAST(disbursal_date AS VARCHAR) AS disbursal_date,
        CAST(loan_amount AS DOUBLE) AS loan_amount, loan_tenure FROM {apps}"""
    sql["src_application_tags"] = """SELECT loan_application_id_ref, tag_name,
        CAST(date_created AS VARCHAR) AS date_created FROM loan_application_metadata"""
    sql["src_user_history"] = """SELECT user_id_ref, attribution_id,
        CAST(date_created AS VARCHAR) AS date_created FROM app_user_history"""
    sql["src_install_event"] = """SELECT attribution_id, campaign_type,
        CAST(date_created AS VARCHAR) AS date_created FROM install_event"""
    sql["src_params_row"] = f"""SELECT CAST(t AS VARCHAR) AS now_ts,
        CAST(CAST(date_trunc('month', t) AS TIMESTAMP) AS VARCHAR) AS current_month_start,
        CAST(CAST(date_trunc('month', t) - INTERVAL 1 MONTH AS TIMESTAMP) AS VARCHAR)
          AS last_month_start,
        CAST(CAST(CAST(t AS DATE) - INTERVAL 1 MONTH AS TIMESTAMP) AS VARCHAR)
          AS same_day_last_month,
        CAST(CAST(date_trunc('month', t) - INTERVAL 1 SECOND AS TIMESTAMP) AS VARCHAR)
          AS last_month_end
        FROM (SELECT max(date_created) AS t FROM {apps})"""

    # Anchors of every application's creation time.
    def anchor_counts(**values: str) -> str:
        named = ", ".join(f"CAST({value} AS VARCHAR) AS {name}" for name, value in values.items())
        return f"SELECT {named}, count(*) AS applications FROM {apps} GROUP BY ALL"

    day = "CAST(date_created AS DATE)"
    month = f"CAST(date_trunc('month', {day}) AS DATE)"
    last_month = f"CAST({month} - INTERVAL 1 MONTH AS DATE)"
    same_day = f"CAST({day} - INTERVAL 1 MONTH AS DATE)"
    sql["anchor_now"] = anchor_counts(now_ts="date_created")
    sql["anchor_today"] = anchor_counts(today=day)
    sql["anchor_current_month_start"] = anchor_counts(
        as_instant=f"CAST({month} AS TIMESTAMP)", as_date=month
    )
    sql["anchor_last_month_start"] = anchor_counts(
        as_instant=f"CAST({last_month} AS TIMESTAMP)", as_date=last_month
    )
    sql["anchor_same_day_last_month"] = anchor_counts(
        as_instant=f"CAST({same_day} AS TIMESTAMP)", as_date=same_day
    )
    sql["anchor_last_month_end"] = anchor_counts(
        last_month_end=f"CAST(CAST({month} AS TIMESTAMP) - INTERVAL 1 SECOND AS TIMESTAMP)"
    )
    sql["anchor_last_day_of_month"] = anchor_counts(
        this_month=f"last_day({day})", last_month=f"CAST({month} - INTERVAL 1 DAY AS DATE)"
    )
    sql["anchor_yesterday"] = anchor_counts(yesterday=f"CAST({day} - INTERVAL 1 DAY AS DATE)")

    # Period pivots and metrics.
    def pivot(source: str, grain: str = "ts", **keys: str) -> str:
        named = ", ".join(f"{value} AS {name}" for name, value in keys.items())
        grouped = ", ".join(keys)
        return f"""SELECT {grouped}, {c.pivot(grain)}
            FROM (SELECT *, {named} FROM {source}) GROUP BY {grouped}"""

    def funnel(pivoted: str, *keys: str, where: str = "true") -> str:
        grouped = ", ".join(keys)
        return f"""SELECT {grouped}, {MEASURES}, {ALL_METRICS}
            FROM ({pivoted}) WHERE {where} ORDER BY {grouped} NULLS FIRST"""

    mom = pivot(recent, programme=SINGLE)
    partner = pivot(recent, programme=TWO, partner_bucket=PARTNER)
    platform = pivot(recent, programme=TWO, platform=PLATFORM)
    ticket = pivot(recent, programme=TWO, ticket_size=TICKET)

    # Joins, with every pair formed.
    tagged = f"""(SELECT loan_application_id_ref, {TAG} AS tag_bucket
        FROM loan_application_metadata WHERE CAST(date_created AS DATE) >= {c.days_60})"""
    low = f"(SELECT * FROM {tagged} WHERE tag_bucket = 'LowNGrow')"
    starter = f"(SELECT * FROM {tagged} WHERE tag_bucket = 'Starter')"
    either = f"""(SELECT * FROM loan_application WHERE CAST(date_created AS DATE) >= {c.days_60}
        OR CAST(disbursal_date AS DATE) >= {c.days_60})"""

    def two_flags(source: str) -> str:
        return f"""(SELECT a.*,
            CAST(l.loan_application_id_ref IS NOT NULL AS INTEGER) AS lowngrow,
            CAST(r.loan_application_id_ref IS NOT NULL AS INTEGER) AS starter
            FROM {source} a LEFT JOIN {low} l ON l.loan_application_id_ref = a.id
            LEFT JOIN {starter} r ON r.loan_application_id_ref = a.id)"""

    def one_bucket(source: str) -> str:
        return f"""(SELECT a.*, t.tag_bucket FROM {source} a LEFT JOIN
            (SELECT * FROM {tagged} WHERE tag_bucket IS NOT NULL) t
            ON t.loan_application_id_ref = a.id)"""

    sql["join_left_tag_flag"] = f"""SELECT loan_product_id,
        CAST(l.loan_application_id_ref IS NOT NULL AS INTEGER) AS lowngrow,
        count(DISTINCT a.id) AS applications, count(*) AS joined_rows
        FROM loan_application a LEFT JOIN {low} l ON l.loan_application_id_ref = a.id
        GROUP BY ALL"""
    sql["join_left_two_tag_flags"] = f"""SELECT loan_product_id, lowngrow, starter,
        count(DISTINCT id) AS applications, count(*) AS joined_rows
        FROM {two_flags(apps)} GROUP BY ALL"""
    sql["join_left_tag_bucket"] = f"""SELECT loan_product_id, tag_bucket,
        count(DISTINCT id) AS applications, count(*) AS joined_rows
        FROM {one_bucket(apps)} GROUP BY ALL"""
    sql["cls_repeat_bucket_flags"] = f"""SELECT loan_product_id, app_name, lowngrow, starter,
        {FLAGS} AS label, count(DISTINCT id) AS applications
        FROM {two_flags(apps)} GROUP BY ALL"""
    sql["cls_repeat_bucket_coalesce"] = f"""SELECT loan_product_id, app_name, tag_bucket,
        coalesce(tag_bucket, {UNTAGGED}) AS label, count(DISTINCT id) AS applications
        FROM {one_bucket(apps)} GROUP BY ALL"""
    sql["join_user_history_range"] = """SELECT a.loan_product_id,
        CAST(h.user_id_ref IS NOT NULL AS INTEGER) AS matched,
        count(DISTINCT a.id) AS applications, count(*) AS joined_rows
        FROM loan_application a LEFT JOIN app_user_history h
        ON a.user_id_ref = h.user_id_ref AND a.date_created > h.date_created - INTERVAL 1 HOUR
        GROUP BY ALL"""
    sql["join_install_range"] = """SELECT h.attribution_id AS source,
        CAST(i.attribution_id IS NOT NULL AS INTEGER) AS matched,
        count(DISTINCT h.row_id) AS applications, count(*) AS joined_rows
        FROM (SELECT *, row_number() OVER () AS row_id FROM app_user_history) h
        LEFT JOIN install_event i
        ON h.attribution_id = i.attribution_id
        AND h.date_created > i.date_created - INTERVAL 1 HOUR
        GROUP BY ALL"""
    attributed = f"""(SELECT a.*, coalesce(i.campaign_type, 'organic') AS campaign
        FROM loan_application a
        JOIN app_user_history h ON a.user_id_ref = h.user_id_ref
         AND a.date_created > h.date_created - INTERVAL 1 HOUR
        JOIN install_event i ON h.attribution_id = i.attribution_id
         AND h.date_created > i.date_created - INTERVAL 1 HOUR
        WHERE a.date_created >= {c.days_150} AND h.date_created >= {c.days_150}
          AND i.date_created >= {c.days_150})"""
    sql["join_null_rejecting_where"] = f"""SELECT {SINGLE} AS programme,
        count(DISTINCT id) AS applications, count(*) AS joined_rows
        FROM {attributed} GROUP BY ALL"""
    sql["join_spread_keys"] = f"""SELECT id,
        count(DISTINCT id) AS applications, count(*) AS joined_rows
        FROM {attributed} GROUP BY ALL"""
    sql["join_cross_params"] = f"""SELECT CAST({c.now} AS VARCHAR) AS now_ts,
        CAST({c.first_ts} AS VARCHAR) AS current_month_start,
        CAST({c.last_first_ts} AS VARCHAR) AS last_month_start,
        CAST({c.same_day_ts} AS VARCHAR) AS same_day_last_month,
        CAST({c.last_end_ts} AS VARCHAR) AS last_month_end, count(*) AS applications,
        count(*) FILTER (date_created BETWEEN {c.first_ts} AND {c.now}) AS current_starts
        FROM {apps}"""

    # Repeat customers and channels.
    repeat = pivot(two_flags(either), programme=REPEAT_ONLY, repeat_bucket=FLAGS)
    repeat_where = f"""programme IN {listed([k.MVL_REPEAT, k.DP_REPEAT])}
        AND repeat_bucket IN ('LowNGrow', 'Starter', 'Regular')"""

    def repeat_pair(last: str, current: str) -> str:
        return f"""SELECT repeat_bucket, {last}, {current}
            FROM ({funnel(repeat, 'programme', 'repeat_bucket', where=repeat_where)})
            ORDER BY repeat_bucket"""

    branches = f"""(SELECT * FROM loan_application WHERE CAST(date_created AS DATE) >= {c.days_60}
        UNION ALL
        SELECT * FROM loan_application WHERE CAST(disbursal_date AS DATE) >= {c.days_60})"""
    starts = pivot(
        one_bucket(branches),
        "date",
        programme=REPEAT_ONLY,
        repeat_bucket=f"coalesce(tag_bucket, {UNTAGGED})",
    )
    channel = pivot(attributed, "date", programme=SINGLE, campaign_type="lower(campaign)")

    # Volume.
    paid = "CAST(disbursal_date AS DATE)"

    def volume(start: str, test: str, end: str) -> str:
        wanted = f"{paid} >= {start} AND {paid} {test} {end}"
        return f"sum(CASE WHEN {wanted} THEN loan_amount ELSE 0 END)"

    prev_mtd = volume(c.last_first, "<", c.same_day)
    mtd = volume(c.first, "<", c.today)
    last_total = volume(c.last_first, "<=", c.last_end)
    projection = rounded(f"(CAST({mtd} AS DOUBLE) * {c.run_rate})")
    volumes = {
        "prev_month_mtd": f"CAST({prev_mtd} AS DOUBLE)",
        "current_month_mtd": f"CAST({mtd} AS DOUBLE)",
        "current_month_total": projection,
        "last_month_total": f"CAST({last_total} AS DOUBLE)",
    }

    def by_programme(source: str, *names: str) -> str:
        named = ", ".join(f"{volumes[name]} AS {name}" for name in names)
        return f"""SELECT programme, {named}
            FROM (SELECT *, {NON_NULL} AS programme FROM {source})
            GROUP BY programme ORDER BY programme"""

    paid_lately = f"""(SELECT * FROM loan_application WHERE loan_product_id IN ('1', '5', '6')
        AND {paid} >= {c.last_first})"""
    volume_report = by_programme(paid_lately, *volumes)
    sql["sink_result"] = sql["agg_single_stage_alias_key"] = volume_report

    # Projections.
    sql["proj_columns"] = f"""SELECT id AS application_id, loan_product_id,
        CAST(loan_amount AS DOUBLE) AS loan_amount FROM {apps}"""
    sql["proj_normalize_timestamps"] = f"""SELECT id,
        CAST(date_created AS VARCHAR) AS date_created,
        CAST(disbursal_date AS VARCHAR) AS disbursal_date FROM {apps}"""
    sql["proj_to_date"] = f"""SELECT id, CAST({day} AS VARCHAR) AS created_date,
        CAST({paid} AS VARCHAR) AS disbursal_date FROM {apps}"""
    paid_month = "CAST(date_trunc('month', disbursal_date) AS TIMESTAMP)"
    sql["proj_month_bucket"] = f"""SELECT
        CAST(CAST({month} AS TIMESTAMP) AS VARCHAR) AS created_month,
        CAST({paid_month} AS VARCHAR) AS disbursed_month,
        count(*) AS applications FROM {apps} GROUP BY ALL"""
    sql["proj_star_extend"] = funnel(mom, "programme")
    sql["proj_explicit_final"] = funnel(platform, "programme", "platform")
    sql["proj_star_output"] = funnel(partner, "programme", "partner_bucket")
    sql["proj_metric_pair"] = f"""SELECT repeat_bucket, last_conversion, current_conversion
        FROM ({funnel(repeat, 'programme', 'repeat_bucket')})"""

    # Classifiers.
    def class_counts(label: str, *inputs: str) -> str:
        columns = ", ".join(inputs)
        return f"""SELECT {columns}, {label} AS label, count(*) AS applications
            FROM {apps} GROUP BY ALL"""

    sql["cls_programme_single_app"] = class_counts(SINGLE, "loan_product_id", "app_name")
    sql["cls_programme_two_app"] = class_counts(TWO, "loan_product_id", "app_name")
    sql["cls_programme_repeat_only"] = class_counts(REPEAT_ONLY, "loan_product_id", "app_name")
    sql["cls_programme_non_null"] = class_counts(NON_NULL, "loan_product_id", "app_name")
    sql["cls_platform"] = class_counts(PLATFORM, "app_name")
    sql["cls_partner_bucket"] = class_counts(PARTNER, "app_name")
    sql["cls_ticket_size"] = class_counts(TICKET, "loan_tenure")
    sql["cls_tag_bucket"] = f"""SELECT tag_name, {TAG} AS label, count(*) AS tags
        FROM loan_application_metadata GROUP BY ALL"""
    sql["cls_campaign_type"] = """SELECT campaign_type,
        CASE WHEN campaign_type IS NULL THEN 'organic' ELSE lower(campaign_type) END AS label,
        count(*) AS installs FROM install_event GROUP BY ALL"""

    # Filters.
    def rows(columns: str, where: str, source: str = apps) -> str:
        return f"SELECT {columns} FROM {source} WHERE {where}"

    made_text = "id, CAST(date_created AS VARCHAR) AS date_created"
    paid_text = "id, CAST(disbursal_date AS VARCHAR) AS disbursal_date"
    sql["flt_lookback_150d"] = rows(made_text, f"date_created >= {c.days_150}")
    sql["flt_lookback_150d_multi"] = " UNION ALL ".join(
        f"""SELECT '{label}' AS relation, count(*) AS kept,
            CAST(min(date_created) AS VARCHAR) AS earliest
            FROM {view} WHERE date_created >= {c.days_150}"""
        for label, view in (
            ("applications", "loan_application"),
            ("history", "app_user_history"),
            ("installs", "install_event"),
        )
    )
    sql["flt_tag_lookback_60d"] = rows(
        "loan_application_id_ref, tag_name, CAST(date_created AS VARCHAR) AS date_created",
        f"CAST(date_created AS DATE) >= {c.days_60}",
        "loan_application_metadata",
    )
    sql["flt_either_date_60d"] = f"""SELECT id, CAST(date_created AS VARCHAR) AS date_created,
        CAST(disbursal_date AS VARCHAR) AS disbursal_date FROM {either}"""
    sql["flt_created_60d"] = rows(made_text, f"{day} >= {c.days_60}")
    sql["flt_disbursed_60d"] = rows(paid_text, f"{paid} >= {c.days_60}")
    sql["flt_disbursed_since_last_month"] = rows(paid_text, f"{paid} >= {c.last_first}")
    sql["flt_in_list"] = rows("id, loan_product_id", "loan_product_id IN ('1', '5', '6')")
    sql["flt_equals"] = rows(f"id, {TWO} AS programme", f"{TWO} = '{k.TOPUP}'")
    sql["flt_not_like"] = rows(f"id, {SINGLE} AS programme", f"{SINGLE} NOT LIKE '%Others%'")
    sql["flt_like_any"] = rows(
        "id, app_name", like_any("app_name", k.PARTNER_GROUPS["BlueChips"])
    )
    sql["flt_null_tests"] = rows(
        paid_text, "loan_product_id IS NULL AND disbursal_date IS NOT NULL"
    )
    sql["flt_not_equal_3vl"] = rows("id, app_name", f"app_name <> '{k.APP_TOPUP}'")
    sql["flt_between"] = rows(made_text, f"{day} BETWEEN {c.last_first} AND {c.same_day}")
    sql["flt_range_closed"] = rows(
        made_text, f"date_created >= {c.last_first_ts} AND date_created <= {c.same_day_ts}"
    )
    sql["flt_range_half_open"] = rows(
        paid_text, f"{paid} >= {c.last_first} AND {paid} < {c.same_day}"
    )

    # Aggregations, sets and ordering.
    def counts(where: str = "true", **keys: str) -> str:
        named = ", ".join(f"{value} AS {name}" for name, value in keys.items())
        order = ", ".join(f"{name} NULLS FIRST" for name in keys)
        return f"""SELECT * FROM (SELECT {named}, count(*) AS applications
            FROM {apps} GROUP BY ALL) WHERE {where} ORDER BY {order}"""

    def pre_grain(keys: str, made: str, paid_at: str) -> str:
        return f"""SELECT {keys}, CAST({made} AS VARCHAR) AS date_created,
            CAST({paid_at} AS VARCHAR) AS disbursal_date, count(*) AS count,
            CAST(sum(CASE WHEN disbursal_date IS NULL THEN 0 ELSE loan_amount END) AS DOUBLE)
              AS amount
            FROM {recent} GROUP BY ALL"""

    sql["flt_post_aggregate"] = counts(
        f"programme = '{k.DP_NEW}'", programme=TWO, partner_bucket=PARTNER
    )
    sql["sort_two_keys"] = counts(programme=TWO, partner_bucket=PARTNER)
    sql["sort_single_key"] = counts(programme=SINGLE)
    sql["sort_nulls_first"] = sql["agg_null_group"] = counts(ticket_size=TICKET)
    sql["agg_count_rows"] = counts(programme=TWO)
    sql["agg_group_by_ordinal"] = counts(programme=TWO, platform=PLATFORM)
    sql["agg_pre_grain_ts"] = pre_grain(
        f"loan_product_id, {SINGLE} AS programme", "date_created", "disbursal_date"
    )
    sql["agg_pre_grain_ts_no_product"] = pre_grain(
        f"{TWO} AS programme, {TICKET} AS ticket_size", "date_created", "disbursal_date"
    )
    sql["agg_pre_grain_date"] = pre_grain(
        f"loan_product_id, {SINGLE} AS programme, {PLATFORM} AS platform", day, paid
    )
    sql["agg_sum_if_disbursed"] = f"""SELECT {TWO} AS programme,
        CAST(sum(CASE WHEN disbursal_date IS NULL THEN 0 ELSE loan_amount END) AS DOUBLE) AS amount
        FROM {apps} GROUP BY ALL"""
    sql["agg_period_pivot_ts"] = f"SELECT programme, {MEASURES} FROM ({mom})"
    sql["agg_period_pivot_date"] = (
        f"SELECT programme, {MEASURES} FROM ({pivot(recent, 'date', programme=SINGLE)})"
    )
    sql["agg_period_pivot_starts_only"] = (
        "SELECT programme, last_starts, current_starts "
        f"FROM ({pivot(apps, 'date', programme=REPEAT_ONLY)})"
    )
    sql["agg_two_level"] = f"SELECT programme, partner_bucket, {MEASURES} FROM ({partner})"
    sql["set_union_all"] = f"""SELECT {REPEAT_ONLY} AS programme, count(*) AS rows
        FROM {branches} GROUP BY ALL"""

    # Scalar functions.
    def value(expression: str, text: bool = False) -> str:
        shown = f"CAST({expression} AS VARCHAR)" if text else expression
        return f"SELECT id, {shown} AS value FROM {apps}"

    def value_counts(expression: str, view: str = apps, name: str = "applications") -> str:
        return f"SELECT {expression} AS value, count(*) AS {name} FROM {view} GROUP BY ALL"

    sql["fn_current_timestamp"] = value_counts(
        "CAST(date_created <= CAST(now() AS TIMESTAMP) AS INTEGER)"
    )
    sql["fn_current_date"] = value_counts(f"CAST({day} <= current_date AS INTEGER)")
    sql["fn_timestamp_trunc_month"] = value_counts(f"CAST({paid_month} AS VARCHAR)")
    sql["fn_date_trunc_month"] = value_counts(f"CAST({month} AS VARCHAR)")
    sql["fn_timestamp_cast"] = value(f"CAST({day} AS TIMESTAMP)", text=True)
    sql["fn_date_cast"] = value(paid, text=True)
    sql["fn_date_sub_month"] = value(f"CAST({paid} - INTERVAL 1 MONTH AS DATE)", text=True)
    sql["fn_date_sub_day"] = value(f"{day} - 60", text=True)
    sql["fn_timestamp_sub"] = value("date_created - INTERVAL 150 DAY", text=True)
    sql["fn_interval_arith"] = value("date_created - INTERVAL 1 HOUR", text=True)
    sql["fn_last_day"] = value_counts(f"CAST(last_day({day}) AS VARCHAR)")
    sql["fn_extract_day"] = value_counts("CAST(extract(day FROM date_created) AS INTEGER)")
    sql["fn_round"] = value(rounded("(CAST(loan_amount AS DOUBLE) / 7)"))
    sql["fn_nullif"] = value_counts("nullif(loan_tenure, 6)")
    sql["fn_coalesce"] = value_counts("coalesce(app_name, loan_product_id)")
    sql["fn_upper"] = value_counts("upper(tag_name)", "loan_application_metadata", "tags")
    sql["fn_lower"] = value_counts("lower(campaign_type)", "install_event", "installs")
    sql["fn_like"] = value_counts("CAST(app_name LIKE '%.pb.%' AS INTEGER)")
    sql["fn_case_searched"] = value_counts(
        "CASE WHEN loan_tenure > 6 THEN 'long' WHEN loan_tenure > 3 THEN 'medium' "
        "ELSE 'short or unknown' END"
    )
    sql["fn_arith"] = value(
        "CAST(loan_amount AS DOUBLE) / loan_tenure * 100 - CAST(loan_amount AS DOUBLE)"
    )

    # Metrics.
    for name, expression in METRICS.items():
        sql[f"met_{name}"] = f"SELECT programme, platform, {expression} AS {name} FROM ({platform})"
    sql["met_prev_month_mtd"] = by_programme(apps, "prev_month_mtd")
    sql["met_current_month_mtd"] = by_programme(apps, "current_month_mtd")
    sql["met_current_month_projection"] = by_programme(apps, "current_month_total")
    sql["met_last_month_total"] = by_programme(apps, "last_month_total")

    # Reports.
    sql["rpt_changes_mom"] = funnel(mom, "programme", where=f"programme <> '{k.OTHERS}'")
    sql["agg_day_cube"] = funnel(partner, "programme", "partner_bucket")
    sql["join_bucketed_tags"] = sql["join_left_two_tag_flags"]
    sql["rpt_volume_projection"] = volume_report
    for metric in ("disb_amount", "starts", "conversion", "ats"):
        sql[f"rpt_partner_{metric}"] = funnel(
            partner, "programme", "partner_bucket", where=f"programme = '{k.DP_NEW}'"
        )
        sql[f"rpt_platform_{metric}"] = funnel(
            platform, "programme", "platform", where=f"programme = '{k.MVL_NEW}'"
        )
        sql[f"rpt_channel_{metric}"] = funnel(
            channel, "programme", "campaign_type", where=f"programme = '{k.MVL_NEW}'"
        )
        sql[f"rpt_topup_{metric}"] = funnel(
            ticket, "programme", "ticket_size", where=f"programme = '{k.TOPUP}'"
        )
    sql["rpt_repeat_disb_amount"] = repeat_pair("last_disbursed_amt", "current_disbursed_amt")
    sql["rpt_repeat_ats"] = repeat_pair("last_ats", "current_ats")
    sql["rpt_repeat_conversion"] = repeat_pair("last_conversion", "current_conversion")
    sql["rpt_repeat_starts"] = f"""SELECT repeat_bucket, last_starts, current_starts,
        {METRICS["change_in_starts_pct"]} AS change_in_starts_pct
        FROM ({starts}) WHERE {repeat_where} ORDER BY repeat_bucket"""

    return {name: with_views(body) for name, body in sql.items()}
