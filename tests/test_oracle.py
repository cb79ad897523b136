"""Every query against SQL on a second engine."""

import pytest

from checks import oracle, queries
from tests.conftest import AS_OF, TESTDATA, sorted_rows

# One report per distinct table; the others share it.
FAMILIES = [
    "rpt_changes_mom",
    "rpt_volume_projection",
    "rpt_partner_ats",
    "rpt_platform_ats",
    "rpt_channel_ats",
    "rpt_repeat_ats",
    "rpt_repeat_starts",
    "rpt_topup_ats",
]
# First of a month, a clamped day, and days the 60-day bound does not reach the first of.
EDGES = ["2000-03-01 00:00:00", "2000-03-31 09:00:00", "2000-08-31 23:59:59", "2001-01-31 12:00:00"]


def same(spark, duck, name, as_of, scale):
    df = queries.registry(as_of)[name](spark, f"{TESTDATA}/{scale}")
    got = sorted_rows(df.columns, df.collect())
    columns, rows = duck(scale, oracle.build(as_of)[name])
    assert sorted(df.columns) == sorted(columns)
    assert got == sorted_rows(columns, rows)
    return got


def test_every_query_has_sql():
    assert set(queries.registry()) == set(oracle.build(AS_OF))


@pytest.mark.parametrize("name", sorted(queries.registry()))
def test_query(spark, duck, name):
    assert same(spark, duck, name, AS_OF, "sf0.001")


@pytest.mark.parametrize("as_of", EDGES)
@pytest.mark.parametrize("name", FAMILIES)
def test_report_at_edge_days(spark, duck, name, as_of):
    same(spark, duck, name, as_of, "sf0.01")


@pytest.mark.parametrize("name", ["rpt_channel_ats", "rpt_repeat_ats", "rpt_repeat_starts"])
def test_joined_report_at_scale(spark, duck, name):
    assert same(spark, duck, name, AS_OF, "sf0.1")
