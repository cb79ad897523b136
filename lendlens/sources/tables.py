"""The relations a report reads, from Parquet or from the catalog."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.functions.anchors import PeriodAnchors
from lendlens.session import configure
from lendlens.sources.schemas import Layout, checked

Layouts = Mapping[str, Sequence[Layout]]


class Sources:
    """Each relation is opened, and its schema checked, when first used.

    ``layouts`` declares, by relation, the date columns that a table is laid out by.
    """

    def __init__(
        self,
        spark: SparkSession,
        read: Callable[[str], DataFrame],
        layouts: Layouts | None = None,
    ):
        self._read = read
        self._layouts = layouts or {}
        #: Closed days that funnel reports read in place of applications (plans/day_cube.py).
        self.day_cube = None
        #: Tags by application and day, stored in buckets (operators/by_application.py).
        self.tag_days: DataFrame | None = None
        configure(spark)

    def with_tag_days(self, days: DataFrame) -> Sources:
        """The same relations, with tags read from their stored days."""
        other = copy(self)
        other.tag_days = days
        return other

    def with_day_cube(self, cube) -> Sources:
        """The same relations, with funnel reports on the closed days of a ``DayCube``."""
        other = copy(self)
        other.day_cube = cube
        return other

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        directory: str,
        names: Mapping[str, str] | None = None,
        layouts: Layouts | None = None,
    ) -> Sources:
        """One Parquet dataset per relation, ``<directory>/<relation>``.

        ``names`` has the datasets called otherwise, as a name in the directory or as a
        whole path.
        """
        named = names or {}

        def read(relation: str) -> DataFrame:
            name = named.get(relation, relation)
            whole = name.startswith("/") or ":/" in name
            return spark.read.parquet(name if whole else f"{directory}/{name}")

        return cls(spark, read, layouts)

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        tables: Mapping[str, str] | None = None,
        layouts: Layouts | None = None,
    ) -> Sources:
        """Catalog tables; ``tables`` names those not called like their relation."""
        named = tables or {}
        return cls(spark, lambda name: spark.table(named.get(name, name)), layouts)

    def _open(self, relation: str) -> DataFrame:
        return checked(self._read(relation), relation, self._layouts.get(relation, ()))

    @cached_property
    def loan_application(self) -> DataFrame:
        return self._open("loan_application")

    @cached_property
    def loan_application_metadata(self) -> DataFrame:
        return self._open("loan_application_metadata")

    @cached_property
    def app_user_history(self) -> DataFrame:
        return self._open("app_user_history")

    @cached_property
    def install_event(self) -> DataFrame:
        return self._open("install_event")


def params_row(as_of: DataFrame, column: str) -> DataFrame:
    """The anchors of a one-row relation's instant, as a one-row relation."""
    anchors = PeriodAnchors.of(F.col(column))
    return as_of.select(*(value.alias(name) for name, value in anchors.instants().items()))

