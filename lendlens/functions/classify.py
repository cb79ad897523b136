"""Cohort classifiers: ordered rules, the first that holds gives the label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendlens import constants as k

Rule = tuple[Column, str]


def case_of(rules: Sequence[Rule], default: str | Column | None = None) -> Column:
    """Chain the rules; without a default a row no rule matches gets NULL."""
    (condition, label), *rest = rules
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    if default is None:
        return chain
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(or_, (text.contains(part) for part in parts))


def _programme(own_apps: Sequence[str], null_product_is_new: bool) -> Column:
    product, app = F.col("loan_product_id"), F.col("app_name")
    new = product.isin(*k.NEW_PRODUCTS)
    if null_product_is_new:
        new = new | product.isNull()
    repeat = product == k.REPEAT_PRODUCT
    own = app.isin(*own_apps)
    return case_of(
        [
            (new & own, k.MVL_NEW),
            (repeat & own, k.MVL_REPEAT),
            (repeat & (app == k.APP_TOPUP), k.TOPUP),
            (new, k.DP_NEW),
            (repeat, k.DP_REPEAT),
        ],
        k.OTHERS,
    )


def programme_single_app() -> Column:
    """The iOS app counts as a partner here."""
    return _programme([k.APP_MAIN], null_product_is_new=True)


def programme_two_app() -> Column:
    return _programme([k.APP_MAIN, k.APP_IOS], null_product_is_new=True)


def programme_non_null() -> Column:
    """As the single-app rule, but an unknown product is not new business."""
    return _programme([k.APP_MAIN], null_product_is_new=False)


def programme_repeat_only() -> Column:
    """Repeat business only; top-up apps land with the partners."""
    repeat = F.col("loan_product_id") == k.REPEAT_PRODUCT
    own = F.col("app_name").isin(k.APP_MAIN, k.APP_IOS)
    return case_of([(repeat & own, k.MVL_REPEAT), (repeat, k.DP_REPEAT)], k.OTHERS)


def platform() -> Column:
    return case_of(
        [(F.col("app_name").contains(k.IOS_MARK), k.PLATFORM_IOS)], k.PLATFORM_DEFAULT
    )


def partner_bucket() -> Column:
    """Case-sensitive; the first group with a matching part wins."""
    app = F.col("app_name")
    rules = [(contains_any(app, parts), label) for label, parts in k.PARTNER_GROUPS.items()]
    return case_of(rules, k.PARTNER_DEFAULT)


def ticket_size() -> Column:
    """NULL for an unknown tenure."""
    tenure = F.col("loan_tenure")
    return case_of(
        [
            (tenure < k.MICRO_TENURE, k.TICKET_MINI),
            (tenure == k.MICRO_TENURE, k.TICKET_MICRO),
            (tenure > k.MICRO_TENURE, k.TICKET_REGULAR),
        ]
    )


def tag_bucket() -> Column:
    """NULL for a tag of neither group."""
    tag = F.upper("tag_name")
    return case_of(
        [
            (tag.isin(*k.LOW_AND_GROW_TAGS), k.BUCKET_LOW_AND_GROW),
            (tag.isin(*k.STARTER_TAGS), k.BUCKET_STARTER),
        ]
    )


def _repeat_not_topup() -> Column:
    return (F.col("loan_product_id") == k.REPEAT_PRODUCT) & (F.col("app_name") != k.APP_TOPUP)


def repeat_bucket_flags() -> Column:
    """From the two tag-match ids; tags count only for repeat, non-top-up loans."""
    guard = _repeat_not_topup()
    return case_of(
        [
            (F.col("lowngrow_id").isNotNull() & guard, k.BUCKET_LOW_AND_GROW),
            (F.col("starter_id").isNotNull() & guard, k.BUCKET_STARTER),
            (guard, k.BUCKET_REGULAR),
        ],
        k.BUCKET_OTHERS,
    )


def repeat_bucket_coalesce() -> Column:
    """The tag's own bucket if there is one, whatever the product or app."""
    untagged = case_of([(_repeat_not_topup(), k.BUCKET_REGULAR)], k.BUCKET_OTHERS)
    return F.coalesce(F.col("tag_bucket"), untagged)


def campaign_type() -> Column:
    return F.coalesce(F.lower("campaign_type"), F.lit(k.ORGANIC))
