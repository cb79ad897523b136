from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

from lendlens import constants as k
from lendlens.session import configure
from lendlens.sources.tables import Sources

TESTDATA = "/root/testdata"
AS_OF = "2000-03-15 13:30:00"

APPLICATION = (
    "id bigint, user_id_ref bigint, loan_product_id string, app_name string, "
    "date_created timestamp_ntz, disbursal_date timestamp_ntz, "
    "loan_amount decimal(18,2), loan_tenure int"
)
TAG = "loan_application_id_ref bigint, tag_name string, date_created timestamp_ntz"
HISTORY = "user_id_ref bigint, attribution_id string, date_created timestamp_ntz"
INSTALL = "attribution_id string, campaign_type string, date_created timestamp_ntz"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lendlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Plan tests read whole filter lists.
        .config("spark.sql.maxMetadataStringLength", "5000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the test tables of a scale."""
    connections = {}

    def run(scale: str, sql: str):
        if scale not in connections:
            con = duckdb.connect()
            for table in ("orders", "lineitem"):
                path = f"{TESTDATA}/{scale}/{table}.parquet"
                con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
            connections[scale] = con
        cursor = connections[scale].execute(sql)
        return [column[0] for column in cursor.description], cursor.fetchall()

    return run


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


class Made:
    """Hand-made source rows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.apps, self.tags, self.history, self.installs = [], [], [], []

    def app(
        self,
        created: str,
        disbursed: str | None = None,
        *,
        product: str | None = "1",
        app: str | None = k.APP_MAIN,
        amount: str | None = "100.00",
        tenure: int | None = 6,
        user: int | None = 1,
        id: int | None = None,
    ) -> Made:
        key = len(self.apps) + 1 if id is None else id
        value = None if amount is None else Decimal(amount)
        self.apps.append((key, user, product, app, at(created), at(disbursed), value, tenure))
        return self

    def tag(self, application: int, *names: str, created: str = "2000-03-10") -> Made:
        self.tags += [(application, name, at(created)) for name in names]
        return self

    def visit(self, user: int | None, attribution: str | None, created: str) -> Made:
        self.history.append((user, attribution, at(created)))
        return self

    def install(self, attribution: str | None, campaign: str | None, created: str) -> Made:
        self.installs.append((attribution, campaign, at(created)))
        return self

    def frames(self) -> dict[str, DataFrame]:
        return {
            "loan_application": self.spark.createDataFrame(self.apps, APPLICATION),
            "loan_application_metadata": self.spark.createDataFrame(self.tags, TAG),
            "app_user_history": self.spark.createDataFrame(self.history, HISTORY),
            "install_event": self.spark.createDataFrame(self.installs, INSTALL),
        }

    def sources(self) -> Sources:
        return Sources(self.spark, self.frames().__getitem__)


@pytest.fixture
def made(spark):
    return Made(spark)


def sorted_rows(columns, rows):
    """Rows with columns in name order, in an order of their own."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cut = [tuple(row[i] for i in order) for row in rows]
    return sorted(cut, key=lambda row: tuple((cell is None, str(cell)) for cell in row))


def by_key(df: DataFrame, *keys: str) -> dict:
    """Rows as dicts, by key; a single key is not wrapped."""
    rows = [row.asDict() for row in df.collect()]
    return {
        (row[keys[0]] if len(keys) == 1 else tuple(row[key] for key in keys)): row for row in rows
    }
