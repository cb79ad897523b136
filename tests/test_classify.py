import pytest
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions import classify

OWN, IOS, TOP = k.APP_MAIN, k.APP_IOS, k.APP_TOPUP
OTHER = "com.phonepe.app"


def labels(spark, column, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


PROGRAMMES = [
    # product, app, single app, two app, repeat only, non-null
    ("1", OWN, k.MVL_NEW, k.MVL_NEW, k.OTHERS, k.MVL_NEW),
    ("5", OWN, k.MVL_NEW, k.MVL_NEW, k.OTHERS, k.MVL_NEW),
    (None, OWN, k.MVL_NEW, k.MVL_NEW, k.OTHERS, k.OTHERS),
    ("6", OWN, k.MVL_REPEAT, k.MVL_REPEAT, k.MVL_REPEAT, k.MVL_REPEAT),
    ("1", IOS, k.DP_NEW, k.MVL_NEW, k.OTHERS, k.DP_NEW),
    ("6", IOS, k.DP_REPEAT, k.MVL_REPEAT, k.MVL_REPEAT, k.DP_REPEAT),
    ("6", TOP, k.TOPUP, k.TOPUP, k.DP_REPEAT, k.TOPUP),
    ("1", TOP, k.DP_NEW, k.DP_NEW, k.OTHERS, k.DP_NEW),
    (None, None, k.DP_NEW, k.DP_NEW, k.OTHERS, k.OTHERS),
    ("6", None, k.DP_REPEAT, k.DP_REPEAT, k.DP_REPEAT, k.DP_REPEAT),
    ("6", OTHER, k.DP_REPEAT, k.DP_REPEAT, k.DP_REPEAT, k.DP_REPEAT),
    ("2", OWN, k.OTHERS, k.OTHERS, k.OTHERS, k.OTHERS),
    ("2", None, k.OTHERS, k.OTHERS, k.OTHERS, k.OTHERS),
]


@pytest.mark.parametrize(
    "position, rule",
    [
        (0, "programme_single_app"),
        (1, "programme_two_app"),
        (2, "programme_repeat_only"),
        (3, "programme_non_null"),
    ],
)
def test_programme(spark, position, rule):
    inputs = [row[:2] for row in PROGRAMMES]
    got = labels(
        spark, getattr(classify, rule)(), "loan_product_id string, app_name string", inputs
    )
    assert got == [row[2 + position] for row in PROGRAMMES]


def test_partner_bucket(spark):
    expected = {
        "x.supermoney.y": "BlueChips",
        "airtel": "BlueChips",
        "com.pb.x": "BlueChips",
        "com.pb.fbpa": "BlueChips",
        "a.pbpq.b": "BlueChips",
        "tatadigital.phonepe": "BlueChips",
        "com.pbx": "PennyStocks",
        "xpbx": "PennyStocks",
        "fbpa": "Small - IPOs",
        "a.fb.b": "Small - IPOs",
        "advisor.abcd": "Small - IPOs",
        "moneycontrol": "Big - IPOs",
        "PHONEPE": "PennyStocks",
        "": "PennyStocks",
        None: "PennyStocks",
    }
    rows = [(app,) for app in expected]
    got = labels(spark, classify.partner_bucket(), "app_name string", rows)
    assert got == list(expected.values())


def test_platform(spark):
    rows = [(k.APP_IOS,), ("com.other.ios",), ("iosapp",), (k.APP_MAIN,), (None,)]
    got = labels(spark, classify.platform(), "app_name string", rows)
    assert got == ["iOS", "iOS", "Android", "Android", "Android"]


def test_ticket_size(spark):
    got = labels(spark, classify.ticket_size(), "loan_tenure int", [(5,), (6,), (7,), (None,)])
    assert got == ["Mini", "Micro", "Regular", None]


def test_tag_bucket(spark):
    rows = [("low_and_grow",), ("Starter_Repeat",), ("LOW_AND_GROW_X",), (None,)]
    got = labels(spark, classify.tag_bucket(), "tag_name string", rows)
    assert got == ["LowNGrow", "Starter", None, None]


def test_repeat_bucket_flags(spark):
    schema = "lowngrow_id bigint, starter_id bigint, loan_product_id string, app_name string"
    rows = [
        (1, 1, "6", OWN),
        (None, 1, "6", OWN),
        (None, None, "6", OTHER),
        (1, None, "6", TOP),
        (1, None, "1", OWN),
        (1, 1, "6", None),
    ]
    got = labels(spark, classify.repeat_bucket_flags(), schema, rows)
    assert got == ["LowNGrow", "Starter", "Regular", "Others", "Others", "Others"]


def test_repeat_bucket_coalesce(spark):
    schema = "tag_bucket string, loan_product_id string, app_name string"
    rows = [("LowNGrow", "6", TOP), ("Starter", "1", None), (None, "6", OWN), (None, "6", None)]
    got = labels(spark, classify.repeat_bucket_coalesce(), schema, rows)
    assert got == ["LowNGrow", "Starter", "Regular", "Others"]


def test_campaign_type(spark):
    rows = [("UAC",), ("",), (None,)]
    got = labels(spark, classify.campaign_type(), "campaign_type string", rows)
    assert got == ["uac", "", "organic"]


def test_no_default_gives_null(spark):
    column = classify.case_of([(F.col("x") > 1, "a")])
    assert labels(spark, column, "x int", [(2,), (1,), (None,)]) == ["a", None, None]
