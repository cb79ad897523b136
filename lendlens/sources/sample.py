"""The four relations derived from order and line-item tables (see FIXTURES.md).

Labels come from the order key; times from the order and ship dates. Offsets stay
within a day, so the order date is the day of ``date_created``; declared as a layout it
takes bounds to the scan of the underlying table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from lendlens import constants as k
from lendlens.sources.schemas import Layout
from lendlens.sources.tables import Sources

# Fixed values of the sample: label by remainder.
PRODUCT_BY_DIGIT = ["1", "1", "1", "5", None, "6", "6", "6", "6", "2"]
APP_BY_SLOT = [
    *[k.APP_MAIN] * 5,
    *[k.APP_IOS] * 2,
    *[k.APP_TOPUP] * 2,
    "com.supermoney.app",
    "com.agg.pb.stpl.web",
    "com.fintifi.app",
    "com.agg.fb.web",
    "com.phonepe.app",
    "com.other.ios",
    None,
]
TAG_BY_SLOT = [
    "low_and_grow",
    "PremiumLowNGrowRepeat",
    "LOW_AND_GROW_PC",
    "REGULARLOWNGROWREPEAT",
    "STARTER_REPEAT",
    "starter_relaxed_bureau",
    *["OTHER_TAG"] * 3,
]
CAMPAIGN_BY_SLOT = ["UAC", "Facebook", "affiliate", None, "REFERRAL"]
UNATTRIBUTED_PRIORITY = "5-LOW"


def _pick(labels: list[str | None], number: str) -> str:
    choices = ", ".join("null" if label is None else f"'{label}'" for label in labels)
    return f"get(array({choices}), cast({number} % {len(labels)} as int))"


def _at(hours: int, minutes: int = 0) -> str:
    """The order date plus a key-dependent time of day."""
    return (
        "cast(o_orderdate as timestamp_ntz) + make_dt_interval("
        f"0, cast(o_orderkey * {hours} % 24 as int), cast(o_orderkey * {minutes} % 60 as int))"
    )


# Ten neighbouring customers share one attribution id.
SHARED_ID = "concat('att-', o_custkey div 10)"


def loan_application(orders: DataFrame) -> DataFrame:
    delay = "make_dt_interval(if(o_orderkey % 2 = 0, 9, 33))"
    return orders.selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id_ref",
        f"{_pick(PRODUCT_BY_DIGIT, 'o_orderkey')} as loan_product_id",
        f"{_pick(APP_BY_SLOT, '(o_orderkey div 10)')} as app_name",
        f"{_at(7, 37)} as date_created",
        f"case when o_orderstatus <> 'P' then {_at(7, 37)} + {delay} end as disbursal_date",
        "case when o_orderkey % 29 <> 0 then cast(o_totalprice as decimal(18,2)) end"
        " as loan_amount",
        "case when o_orderkey % 23 <> 0 then cast(3 + o_orderkey % 8 as int) end as loan_tenure",
        "cast(o_orderdate as date) as created_day",
    )


def loan_application_metadata(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey as loan_application_id_ref",
        f"{_pick(TAG_BY_SLOT, 'l_partkey')} as tag_name",
        "cast(l_shipdate as timestamp_ntz) as date_created",
    )


def app_user_history(orders: DataFrame) -> DataFrame:
    alone = f"o_orderpriority = '{UNATTRIBUTED_PRIORITY}'"
    return orders.selectExpr(
        "o_custkey as user_id_ref",
        f"if({alone}, concat('own-', o_orderkey), {SHARED_ID}) as attribution_id",
        f"{_at(5)} as date_created",
        "cast(o_orderdate as date) as created_day",
    )


def install_event(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        f"{SHARED_ID} as attribution_id",
        f"{_pick(CAMPAIGN_BY_SLOT, 'o_orderkey')} as campaign_type",
        f"{_at(11)} as date_created",
        "cast(o_orderdate as date) as created_day",
    )


RELATIONS = {
    "loan_application": ("orders", loan_application),
    "loan_application_metadata": ("lineitem", loan_application_metadata),
    "app_user_history": ("orders", app_user_history),
    "install_event": ("orders", install_event),
}


def sample(spark: SparkSession, directory: str) -> Sources:
    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    def read(relation: str) -> DataFrame:
        name, derive = RELATIONS[relation]
        return derive(table(name))

    laid_out = ("loan_application", "app_user_history", "install_event")
    layout = [Layout("created_day", "date_created")]
    return Sources(spark, read, dict.fromkeys(laid_out, layout))
